"""Exact values at given ranks of groups of any size, without holding or sorting a whole group; places in a total order.

Equal values are counted before any shuffle. The counts are summed up by ranges of value, some hundreds to a power of
ten, whose running sums tell in which range each rank lies; only the values of that one range are put in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of value to a factor of e.
RANGES = 256
#: Above the number of ranges between the least positive double and one.
_OFFSET = 1 << 18

Rank = Callable[[Column], Column]
# Ranks from 1 as functions of the number of values.
LOWER_MIDDLE: Rank = lambda n: F.floor((n + 1) / 2)
UPPER_MIDDLE: Rank = lambda n: F.floor(n / 2) + 1


def nearest(share: float) -> Rank:
    """The least rank at which `share` of the values have come."""
    return lambda n: F.greatest(F.lit(1), F.ceil(n * share))


def value_range(v: Column) -> Column:
    """Number of the range that holds a finite double; greater values are in the same range or a greater one."""
    size = F.floor(F.ln(F.abs(v)) * RANGES) + _OFFSET
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0).cast("bigint")


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Rank], extra: tuple[Column, ...] = ()) -> DataFrame:
    """One row for each group of `keys` with values: n, the named ranks' values, and `extra` aggregates over `_v`, counted `_n` times.

    Null, NaN and infinite values are left out; keys may be null.
    """
    v = F.col(value).cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    # + 0.0 makes the two zeros one
    counted = rows.where(usable).groupBy(*keys, (v + F.lit(0.0)).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_range", value_range(F.col("_v")))
    sums = counted.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum"))
    running = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_sum").over(Window.partitionBy(*keys))
    placed = sums.select(*keys, "_range", F.sum("_sum").over(running).alias("_upto"), "_sum", total.alias("n"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("bigint").alias("rank")) for name, rank in ranks.items()])
    here = F.filter(asked, lambda a: (a["rank"] > F.col("_upto") - F.col("_sum")) & (a["rank"] <= F.col("_upto")))
    wanted = placed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "n", (F.col("_upto") - F.col("_sum")).alias("_before"), F.explode(here).alias("_a"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    inside = counted.join(wanted, [*same, F.col("_range") == F.col("_r")])
    so_far = Window.partitionBy(*keys, "_a.name").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inside.withColumn("_reached", F.col("_before") + F.sum("_n").over(so_far)).where("_reached >= _a.rank")
    picked = reached.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("_a.name") == name, F.col("_v"))).alias(name) for name in ranks])
    if not extra:
        return picked
    more = counted.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*extra)
    return picked.join(more, same).drop(*[f"_k{i}" for i in range(len(keys))])


def medians(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the median of each group that has values, the mean of the two middle ones."""
    found = at_ranks(rows, keys, value, {"_lower": LOWER_MIDDLE, "_upper": UPPER_MIDDLE})
    return found.select(*keys, (0.5 * F.col("_lower") + 0.5 * F.col("_upper")).alias(name))


def in_order(rows: DataFrame, order: list[str], place: str, total: str | None = None) -> DataFrame:
    """`rows` with their place from 0 in a total order, and how many there are; ranges of it are sorted apart, and their sizes, one number each, are added up."""
    placed = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    number = (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(place)
    return numbered.select(*rows.columns, number, *([F.col("_all").alias(total)] if total else []))
