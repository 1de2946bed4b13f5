"""Sharding along a Hilbert curve over quantised metadata, in DataFrame operations only.

Each dimension is cut into 2**bits bins, numbers at their quantiles and strings by rank of whole values; the bins are the coordinates of a point whose
curve index orders the rows, so a run of the order is compact in every dimension and its files prune on
all of them. Runs are cut by rank: row r of N goes to shard r * shards // N, sizes at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.storage import discard, stored


def _curve_tables(n: int) -> tuple[list[int], list[int]]:
    """(digit, next state) by state * 2**n + cell, a state being an entry corner and an axis of the n-cube."""
    size = 1 << n
    turn = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & (size - 1)
    gray = [i ^ (i >> 1) for i in range(size)]
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]
    trailing = [(~i & (i + 1)).bit_length() - 1 for i in range(size)]
    axis = [0] + [(trailing[i] if i % 2 else trailing[i - 1]) % n for i in range(1, size)]
    digit, after = [], []
    for e in range(size):
        for d in range(n):
            for cell in range(size):
                w = gray.index(turn(cell ^ e, n - (d + 1) % n))
                digit.append(w)
                after.append((e ^ turn(entry[w], d + 1)) * n + (d + axis[w] + 1) % n)
    return digit, after


def hilbert_index(df: DataFrame, coordinates: list[str], bits: int, name: str) -> DataFrame:
    """`df` with column `name`: the curve index of points whose coordinates are integer columns below 2**bits.

    One look-up in two constant tables a level, from the coarsest; each level's state is a column of its own.
    """
    n = len(coordinates)
    digit, after = (F.array(*map(F.lit, t)) for t in _curve_tables(n))
    out = df.withColumns({"_h": F.lit(0).cast("bigint"), "_state": F.lit(0)})
    for level in reversed(range(bits)):
        bit = lambda c, level=level: F.shiftright(c, level).bitwiseAND(F.lit(1))
        cell = sum((bit(c) * (1 << k) for k, c in enumerate(coordinates)), F.col("_state") * (1 << n))
        out = out.withColumn("_cell", cell)
        out = out.withColumns({"_h": F.col("_h") * (1 << n) + F.get(digit, F.col("_cell")), "_state": F.get(after, F.col("_cell"))})
    return out.withColumn(name, F.col("_h")).drop("_h", "_state", "_cell")


def _running(df: DataFrame, order: list[str], weight: str) -> DataFrame:
    """`df` stored in order with _before, the sum of `weight` over the rows before, and _all, the sum of all.

    Partitions are ranges of the order; their sums, one row a partition, are added up first.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(df.repartitionByRange(tasks, *order).withColumn("_part", F.spark_partition_id()))
    sums = cut.groupBy("_part").agg(F.sum(weight).alias("_n"))
    parts = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    inside = F.sum(weight).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # one row a partition of the sort, whatever the number of rows
    return cut.withColumn("_inside", inside - F.col(weight)).join(F.broadcast(parts), "_part").withColumn("_before", F.col("_first") + F.col("_inside"))


def string_cuts(df: DataFrame, column: str, bits: int) -> list[str]:
    """Least values of the bins above the first, whole strings in binary order.

    With no more distinct values than bins each has its own; else bins hold about equal numbers of rows.
    """
    bins = 1 << bits
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_rows"))
    few = [r[0] for r in values.select("_value").orderBy("_value").limit(bins + 1).collect()]
    if len(few) <= bins:
        return few[1:]
    placed = _running(values, ["_value"], "_rows").withColumn("_bin", F.expr(f"_before * {bins} div _all"))
    return sorted(r[0] for r in placed.groupBy("_bin").agg(F.min("_value")).where("_bin > 0").select("min(_value)").collect())


def number_cuts(df: DataFrame, columns: list[str], bits: int) -> dict[str, list[float]]:
    """Distinct quantiles of each numeric column, over all rows."""
    if not columns:
        return {}
    steps = F.array(*[F.lit(k / (1 << bits)) for k in range(1, 1 << bits)])
    found = df.agg(*(F.percentile_approx(F.col(c).cast("double"), steps, 20_000).alias(c) for c in columns)).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def quantised(df: DataFrame, dimensions: list[str], bits: int) -> dict[str, Column]:
    """Bin numbers from 0 to 2**bits - 1 by dimension, between cuts taken over all rows; null is in bin 0."""
    kinds = dict(df.dtypes)
    numbers = number_cuts(df, [d for d in dimensions if kinds[d] != "string"], bits)
    found = {}
    for d in dimensions:
        if kinds[d] == "string":
            above = [F.col(d) >= F.lit(c) for c in string_cuts(df, d, bits)]
        else:
            above = [F.col(d).cast("double") > F.lit(c) for c in numbers[d]]
        found[d] = sum((F.when(x, 1).otherwise(0) for x in above), F.lit(0)).cast("int")
    return found


def hilbert_shards(df: DataFrame, dimensions: list[str], ties: list[str], shards: int, bits: int = 5) -> DataFrame:
    """`df` with shard (int) and slot (bigint, gapless from 0 in each shard), which take the place of columns of these names.

    Dimensions are numeric or string columns. Rows of equal curve index follow `ties`, then their place in the input, so
    that rows alike in everything, of any number, are still cut evenly. All other columns are kept, whatever their names; an
    empty table stays empty. The columns of `df` are shuffled, so give it narrow rows.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    # the rows' own columns travel in one, so that no name of theirs meets a name used here
    cuts, orders = [f"_d{k}" for k in range(len(dimensions))], [f"_t{k}" for k in range(len(ties))]
    narrow = stored(df.select(F.struct(*df.columns).alias("_row"), *[F.col(d).alias(n) for d, n in zip(dimensions, cuts)], *[F.col(t).alias(n) for t, n in zip(ties, orders)]))
    bins = quantised(narrow, cuts, bits)
    points = narrow.select("_row", *orders, *[bins[n].alias(n) for n in cuts])
    curved = hilbert_index(points, cuts, bits, "_curve").select("_row", *orders, "_curve")
    rows = stored(curved.withColumn("_place", F.monotonically_increasing_id()))
    order = ["_curve", *orders, "_place"]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # in sorted partitions this id is the partition's number and the row's place in it
    ordered = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = stored(ordered.select("_row", F.monotonically_increasing_id().alias("_at")))
    discard(narrow, rows)
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row a partition of the sort, whatever the number of rows
    before = sizes.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all")
    )
    ranked = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranked.withColumn("_rank", rank)
        .withColumn("shard", F.expr(f"cast(_rank * {shards} div _all as int)"))
        .withColumn("slot", F.expr(f"_rank - (shard * _all + {shards - 1}) div {shards}"))
        .select(*[F.col("_row")[c].alias(c) for c in kept], "shard", "slot")
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs` under the law `rows`.

    The dimensions are source, lang and size. A null text has size 8 and, as an empty one, checksum 0; a text of any
    length is read whole. Other columns, of whatever names, are ignored; repeated rows each get a place.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source"),
        F.col("lang"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return hilbert_shards(narrow, ["source", "lang", "size"], ["size", "text_crc32", "doc_id"], shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder of Parquet files a shard, rows in slot order in each; the tasks are ranges of slots, so a shard spans several."""
    tasks = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = sharded.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot")
    cut.write.partitionBy("shard").parquet(path)
