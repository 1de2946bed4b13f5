"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments, one table each; a segment has about as many bits as the number of distinct codes, so that
a bucket holds a few whatever their number. Every round searches all tables one bit further from the query's segment.
By the pigeonhole principle a code within segments * (radius + 1) - 1 bits of the query has been seen after the
round; a query is done when its kth verified distance is no more than that.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.storage import discard, stored

#: Bounds of a segment's bits. A round looks up at most 2**MOST_BITS values, so the table of masks is bounded too.
LEAST_BITS, MOST_BITS = 4, 18
#: Bits in each number of a code.
WORD = 32


def sign_codes(vectors: DataFrame) -> DataFrame:
    """(id, code): bit i tells whether component i is above zero; null vectors are left out.

    A code is an array of 32-bit words (as bigints from 0), the first 32 components in the first word.
    """
    word = f"aggregate(slice(embedding, w * {WORD} + 1, {WORD}), named_struct('s', 0L, 'i', 0), (a, x) -> named_struct('s', a.s | CASE WHEN x > 0 AND NOT isnan(x) THEN shiftleft(1L, a.i) ELSE 0L END, 'i', a.i + 1), a -> a.s)"
    words = f"CASE WHEN size(embedding) = 0 THEN array(0L) ELSE transform(sequence(0, (size(embedding) - 1) div {WORD}), w -> {word}) END"
    return vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("id"), F.expr(words).alias("code"))


def cuts(bits: int, rows: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment, sizes at most one apart."""
    width = min(max(ceil(log2(max(rows, 2))), LEAST_BITS), MOST_BITS, bits)
    n = ceil(bits / width)
    edges = [k * bits // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _segment(at: int, bits: int) -> str:
    """SQL for the bits [at, at + bits) of `code`."""
    word, shift = divmod(at, WORD)
    text = f"shiftright(code[{word}], {shift})"
    if shift + bits > WORD:
        text = f"({text} | shiftleft(code[{word + 1}], {WORD - shift}))"
    return f"cast({text} & {(1 << bits) - 1} AS int)"


def hamming_top_k(items: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, neighbour_id, distance: the k items nearest to each query by Hamming distance, ties by id.

    `items` and `queries` have id and code (array<bigint> of 32-bit words; other columns ignored). Codes of fewer words than the
    longest count as ending in zeros. An item of a query's own id is not its neighbour; rows that repeat id and code
    count once, null ids and codes not at all. A query with fewer than k other items gets all. Items of equal code
    are one entry with its k + 1 least ids, so groups of copies are never listed.
    """
    spark = items.sparkSession
    usable = lambda df: df.where("id IS NOT NULL AND code IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "code")
    words = max((usable(df).agg(F.max(F.size("code"))).first()[0] or 1) for df in (items, queries))
    full = f"CASE WHEN size(code) < {words} THEN concat(code, array_repeat(0L, {words} - size(code))) ELSE code END"
    known = usable(items).withColumn("code", F.expr(full)).distinct()
    for by in (["code", F.pmod(F.xxhash64("id"), F.lit(64))], ["code"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
        known = known.withColumn("_place", place).where(F.col("_place") <= k + 1).drop("_place")
    entries = stored(known.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = stored(usable(queries).select(F.col("id").alias("query_id"), F.expr(full).alias("code")).distinct())
    # bits that no code has set need no table
    highest = F.max(F.expr(f"array_max(transform(sequence(0, {words - 1}), w -> CASE WHEN code[w] <> 0 THEN w * {WORD} + length(bin(code[w])) ELSE 0 END))"))
    used = max(df.agg(highest).first()[0] or 1 for df in (entries, asked))
    parts = cuts(used, entries.count())
    spread = F.posexplode(F.array(*[F.expr(_segment(a, b)) for a, b in parts])).alias("t", "own")
    apart = " + ".join(f"bit_count(code[{w}] ^ other[{w}])" for w in range(words))
    index = stored(entries.select(F.col("code").alias("other"), "ids", spread).withColumnRenamed("own", "value"))
    discard(entries)
    width = max(b for _, b in parts)
    sizes = F.array(*[F.lit(1 << b) for _, b in parts])
    open_, best, finished = asked, None, []
    by_query = Window.partitionBy("query_id", "code").orderBy("distance", F.col("ids")[0])
    for radius in range(width + 1):
        masks = spark.range(1 << width).where(F.bit_count("id") == radius).select(F.col("id").cast("int").alias("mask"))
        probes = open_.select("query_id", "code", spread).crossJoin(F.broadcast(masks)).where(F.col("mask") < F.get(sizes, F.col("t")))
        probes = probes.selectExpr("query_id", "code", "t", "own ^ mask AS value")
        seen = probes.join(index, ["t", "value"]).selectExpr("query_id", "code", "other", "filter(ids, x -> x <> query_id) AS ids", f"{apart} AS distance")
        if best is not None:
            seen = seen.unionByName(best.join(open_, ["query_id", "code"], "left_semi"))
        ranked = seen.where("size(ids) > 0").dropDuplicates(["query_id", "code", "other"])
        after = stored(ranked.withColumn("_place", F.row_number().over(by_query)).where(F.col("_place") <= k).drop("_place"))
        held = F.sum(F.size("ids")).over(by_query.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        reach = len(parts) * (radius + 1) - 1
        done = after.withColumn("_held", held).where(f"_held >= {k} AND distance <= {reach}").select("query_id", "code").distinct()
        left = stored(open_.join(done, ["query_id", "code"], "left_anti"))
        finished.append(stored(after.join(left, ["query_id", "code"], "left_anti")))
        discard(open_, best)
        best, open_ = after, left
        if left.isEmpty():
            break
    finished.append(stored(best.join(open_, ["query_id", "code"], "left_semi")))
    discard(index, open_, best)
    every = finished[0]
    for part in finished[1:]:
        every = every.unionByName(part)
    each = every.select("query_id", "code", "distance", F.explode("ids").alias("neighbour_id"))
    order = Window.partitionBy("query_id", "code").orderBy("distance", "neighbour_id")
    return (
        each.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "neighbour_id", "distance")
    )


def oracle(k: int = 10) -> str:
    """DuckDB SQL for the search of every vector whose id is divisible by 100 among all, over all components."""
    word = f"list_sum(list_transform(range(w * {WORD}, least((w + 1) * {WORD}, len(embedding))), lambda i: CASE WHEN embedding[i + 1] > 0 AND NOT isnan(embedding[i + 1]) THEN (1::BIGINT << (i - w * {WORD})) ELSE 0 END))::BIGINT"
    return f"""WITH codes AS (SELECT vec_id, list_transform(range((len(embedding) + {WORD - 1}) // {WORD}), lambda w: {word}) AS code FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (SELECT q.vec_id AS query_id, o.vec_id AS neighbour_id,
  list_sum(list_transform(range(greatest(len(q.code), len(o.code))), lambda w: bit_count(xor(coalesce(q.code[w + 1], 0), coalesce(o.code[w + 1], 0)))))::INTEGER AS distance
  FROM codes q JOIN codes o ON q.vec_id % 100 = 0 AND q.vec_id <> o.vec_id)
SELECT query_id, rank::INTEGER AS rank, neighbour_id, distance FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs) WHERE rank <= {k}"""
