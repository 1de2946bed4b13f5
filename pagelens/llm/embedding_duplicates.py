"""Near-duplicate vectors: iterative quantisation codes, multi-index Hamming tables, exact reranking.

A rotation is learnt so that the signs of the rotated vectors lose little; they are balanced as far as the vectors
point all ways. Vectors are not centred: links are angles at the origin, and about the mean of a group that holds most
of a table these would be angles between its noise. Codes of several rotations are joined and cut into segments, one
table each; a segment has about as many bits as the number of vectors, so that a bucket holds a few whatever their
number. A pair is retrieved when some segment differs in at most one bit, is taken from the first such table only, and
is then held against the original vectors in double precision. At cosine c each bit differs with probability
acos(c) / pi; there are as many tables as it takes to miss a pair at the threshold with probability MISS. In crowded
buckets vectors within half the threshold's angle of a centre are known to link with one another and are counted as a
ball. Buckets meet by the balls in them, so that the members of one ball never meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import acos, ceil, cos, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.components import connected_components
from pagelens.llm.storage import discard, stored

#: Rotations are learnt from at most this many vectors of the commonest length, the least by a hash of the vector.
SAMPLE = 4096
#: Chance that no table retrieves a pair at the threshold, and bounds of a segment's bits.
MISS, LEAST_BITS, MOST_BITS = 0.002, 8, 28
#: A bucket of at least so many vectors is first held against its centre.
CROWD = 32


def layout(rows: int, cosine: float) -> tuple[int, int]:
    """(bits of a segment, number of tables) for so many vectors."""
    width = min(max(ceil(log2(max(rows, 2))), LEAST_BITS), MOST_BITS)
    p = acos(min(max(cosine, -1.0), 1.0)) / pi
    hit = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    return width, max(1, ceil(log(MISS) / log(1 - hit))) if hit < 1 else 1


def learn_rotations(sample: np.ndarray, count: int, rounds: int = 50) -> list[np.ndarray]:
    """`count` square rotations by iterative quantisation from random starts: a bit for every dimension."""
    dimension, found = sample.shape[1], []
    for k in range(count):
        rotation, _ = np.linalg.qr(np.random.default_rng(k).standard_normal((dimension, dimension)))
        for _ in range(rounds if len(sample) > dimension else 0):
            u, _, v = np.linalg.svd(np.where(sample @ rotation >= 0, 1.0, -1.0).T @ sample)
            rotation = (u @ v).T
        found.append(rotation)
    return found


@cache
def _plain_rotations(dimension: int, count: int) -> list[np.ndarray]:
    """For vectors of another length than the learnt one: random rotations, the same in every task."""
    return learn_rotations(np.empty((0, dimension)), count)


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Components of all vectors as doubles, and where each vector's begin."""
    lists = column.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _encoder(dimension: int, rotations: list[np.ndarray], width: int, tables: int):
    """(node, segments, embedding): the code cut into `tables` integers of `width` bits."""
    powers = 1 << np.arange(width, dtype=np.int64)

    def bits(x: np.ndarray) -> np.ndarray:
        turns = rotations if x.shape[1] == dimension else _plain_rotations(x.shape[1], ceil(tables * width / x.shape[1]))
        return np.concatenate([x @ r >= 0 for r in turns], 1)[:, : tables * width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _rows(batch.column("embedding"))
            sizes = np.diff(offsets)
            segments = np.zeros((len(sizes), tables), np.int32)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                x = _unit(flat[offsets[at][:, None] + np.arange(n)])
                segments[at] = bits(x).reshape(len(at), tables, width) @ powers
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, segments.size + 1, tables), pa.int32()), pa.array(segments.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists, batch.column("embedding")], names=["node", "segments", "embedding"])

    return run


def _verify(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, offsets), (y, _) = (_rows(batch.column(c)) for c in ("x", "y"))
            sizes, value = np.diff(offsets), np.zeros(batch.num_rows)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                places = offsets[at][:, None] + np.arange(n)
                value[at] = (_unit(x[places]) * _unit(y[places])).sum(1)
            chosen = pa.array(value >= cosine)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(chosen) for c in ("a", "b")], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """Pairs (a, b) whose original vectors reach the cosine."""
    found = pairs.join(vectors.withColumnsRenamed({"node": "a", "embedding": "x"}), "a").join(
        vectors.withColumnsRenamed({"node": "b", "embedding": "y"}), "b"
    )
    return found.select("a", "b", "x", "y").mapInArrow(_verify(cosine), "a bigint, b bigint")


def _balls(each: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """(node, ball): vectors of crowded buckets within half the angle of a centre, so that all of one ball link with each other.

    A crowded bucket's centre is its least node; a vector near several goes to the one that most are near.
    """
    crowded = each.groupBy("t", "value", "n").agg(F.count("*").alias("_size"), F.min("node").alias("b")).where(F.col("_size") >= CROWD)
    stars = each.select("t", "value", "n", F.col("node").alias("a")).join(crowded, ["t", "value", "n"]).where("a <> b").select("a", "b").distinct()
    # a hair inside, so that rounding never makes a link of none
    near = stored(_verified(stars, vectors, cos(acos(min(max(cosine, -1.0), 1.0)) / 2) + 1e-9))
    own = near.select(F.col("b").alias("a"), "b").distinct()
    weight = near.groupBy("b").agg(F.count("*").alias("w"))
    best = F.max(F.struct("w", (-F.col("b")).alias("least"), "b"))
    found = stored(near.unionByName(own).join(weight, "b").groupBy(F.col("a").alias("node")).agg(best.alias("m")).select("node", F.col("m.b").alias("ball")))
    discard(near)
    return found


def _candidates(each: DataFrame, width: int, tables: int, cosine: float) -> DataFrame:
    """Pairs (a, b) of nodes in different groups, once each, from rows (node, segments, n, ball, t, value): one for each table t.

    A group is a ball, or a node outside all balls.

    Groups meet in a bucket first, each once, however many members it has there; a group of one brings its member along,
    the members of others are joined to the groups that met.
    """
    member = F.struct("node", "segments")
    held = each.where("ball IS NOT NULL").withColumnRenamed("ball", "g")
    alone = each.where("ball IS NULL").select("t", "value", "n", F.col("node").alias("g"), F.lit(1).cast("bigint").alias("size"), member.alias("one"))
    there = alone.unionByName(held.groupBy("t", "value", "n", "g").agg(F.count("*").alias("size"), F.min(member).alias("one")))
    flips = F.explode(F.array(F.lit(0), *(F.lit(1 << k) for k in range(width)))).alias("flip")
    probes = there.select("t", "n", F.col("g").alias("ga"), F.col("value").alias("va"), F.col("size").alias("sa"), F.col("one").alias("x"), flips).selectExpr("*", "va ^ flip AS value")
    # values that differ in one bit meet both ways; the order of the groups takes one of them
    met = probes.join(there.selectExpr("t", "n", "value", "g AS gb", "size AS sb", "one AS y"), ["t", "n", "value"]).where("ga < gb")
    earlier = " AND ".join([f"(t <= {t} OR bit_count(x.segments[{t}] ^ y.segments[{t}]) > 1)" for t in range(tables - 1)] or ["true"])
    distance = " + ".join(f"bit_count(x.segments[{t}] ^ y.segments[{t}])" for t in range(tables))
    # eight deviations over the mean distance of a pair at the threshold
    p, all_bits = acos(min(max(cosine, -1.0), 1.0)) / pi, tables * width
    farthest = ceil(all_bits * p + 8 * sqrt(all_bits * p * (1 - p)))
    single = met.where("sa = 1 AND sb = 1").select("t", "x", "y")
    # with one member a group brings it along
    of = lambda g, value, x: alone.select("t", "n", F.col("g").alias(g), F.col("value").alias(value), F.col("one").alias(x)).unionByName(held.select("t", "n", F.col("g").alias(g), F.col("value").alias(value), member.alias(x)))
    large = met.where("sa > 1 OR sb > 1").select("t", "n", "ga", "va", "gb", "value")
    large = large.join(of("ga", "va", "x"), ["t", "n", "ga", "va"]).join(of("gb", "value", "y"), ["t", "n", "gb", "value"])
    near = single.unionByName(large.select("t", "x", "y")).where(f"{earlier} AND {distance} <= {farthest}")
    return near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _links(classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes whose cosine reaches the threshold but for pairs inside a ball, and balls (node, ball)."""
    sizes = classes.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n")
    common = sizes.first()
    if common is None:
        empty = classes.sparkSession.createDataFrame([], "a bigint, b bigint")
        return empty, empty.withColumnsRenamed({"a": "node", "b": "ball"})
    dimension, kind = common.n, dict(classes.dtypes)["embedding"]
    width, tables = layout(classes.count(), cosine)
    rows = classes.where(F.size("embedding") == dimension).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding")
    flat, _ = _rows(rows.toArrow()["embedding"].combine_chunks())
    rotations = learn_rotations(_unit(flat.reshape(-1, dimension)), ceil(tables * width / dimension))
    encode = _encoder(dimension, rotations, width, tables)
    coded = stored(classes.select("node", "embedding").mapInArrow(encode, f"node bigint, segments array<int>, embedding {kind}"))
    vectors = coded.select("node", "embedding")
    plain = coded.select("node", F.size("embedding").alias("n"), F.posexplode("segments").alias("t", "value"))
    balls = _balls(plain, vectors, cosine)
    each = coded.select("node", "segments", F.size("embedding").alias("n")).join(balls, "node", "left").select("node", "segments", "n", "ball", F.posexplode("segments").alias("t", "value"))
    found = _candidates(each, width, tables, cosine)
    links = stored(_verified(found, vectors, cosine))
    discard(coded)
    return links, balls


def embedding_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding array of numbers; others ignored).

    Of the pairs at the threshold at least 0.98 are found, also where one group of near vectors holds half of the table, nearly
    all or all of it; pairs above it are found more surely.

    Null, empty and zero vectors and those with null or non-finite components link with nothing and are kept. Vectors
    of different length are not compared. Components count as doubles. Equal vectors are one class with a multiplicity:
    each of m copies has the other m - 1 as links, and every copy of a linked class counts. Equal vec_ids give a row
    each. Links inside a ball of near vectors are counted without being listed; the others are listed, since each counts.
    """
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    ok = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    # 0.0 and -0.0 are one value
    rows = rows.withColumn("node", F.expr(f"CASE WHEN {ok} THEN xxhash64(transform(embedding, x -> x + 0), size(embedding)) END"))
    usable = rows.where("node IS NOT NULL")
    classes = stored(
        usable.groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    )
    links, balls = _links(classes, cosine)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = classes.select(F.col("node").alias("b"), "copies")
    degree = both.join(copies, "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("degree"))
    # within a ball every class has all copies of the others as links
    held = balls.join(classes.select("node", F.col("copies").alias("_own")), "node")
    inside = held.join(held.groupBy("ball").agg(F.sum("_own").alias("_all")), "ball").select("node", (F.col("_all") - F.col("_own")).alias("inside"))
    components = connected_components(links.unionByName(balls.selectExpr("node AS a", "ball AS b")))
    named = classes.select("node", "copies", "least").join(components, "node", "left").join(degree, "node", "left").join(inside, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(first, "component").select(
        "node", "component_id", (F.col("copies") - 1 + F.coalesce("degree", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("n_links")
    )
    of_class = stored(of_class)
    discard(classes)
    return (
        rows.select("vec_id", "node")
        .join(of_class, "node", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
