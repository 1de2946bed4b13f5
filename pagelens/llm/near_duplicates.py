"""Near-duplicate documents by MinHash with tensored banding, each link confirmed on full shingle sets.

Two small collections of hashes are drawn, `side` groups of two minhashes each. Table (i, j) keys a
document by group i of the first collection with group j of the second, so side**2 tables cost only
4 * side minhashes instead of 4 * side**2. A pair of similarity s is missed when all groups of one collection
disagree: 2 * (1 - s**2)**side, 7e-5 at 0.85 and 6e-4 at 0.80 with side = 8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.components import connected_components
from pagelens.llm.storage import discard, stored
from pagelens.llm.words import Words, mix, slices

_FEATURES = "doc_id bigint, row bigint, node bigint, n_shingles bigint, first array<bigint>, second array<bigint>, sketch array<bigint>"
_SETS = "node bigint, shingles array<bigint>"

#: Bits of a set's parity sketch: bit h says whether the shingles hashed to h are odd in number. Two sketches
#: differ in no more bits than the sets in shingles, so the bound on links that they give loses none.
_PARITY = 1024


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingle hashes, in document order, and where each document's begin."""
    table = Words(column, fold_case=True)
    counts = table.counts()
    starts, doc = table.rolling(words)
    hashes = table.windows(starts, words)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        doc = np.concatenate([doc, short])
        hashes = np.concatenate([hashes, table.windows(table.first[:-1][short], counts[short])])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[fresh], hashes[fresh]
    return hashes, np.searchsorted(doc, np.arange(len(column) + 1))


def _nodes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit name for each document's set; documents with equal sets share it."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _lists(values: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    flat = pa.array(values.ravel(), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), flat)


def _features(words: int, side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _multipliers(4 * side)
        for batch in batches:
            text = batch.column("text")
            for lo, hi in slices(text):
                hashes, first = _shingle_sets(text.slice(lo, hi - lo), words)
                some = np.flatnonzero(np.diff(first))
                least = np.empty((len(some), len(factors)), np.uint32)
                for k, a in enumerate(factors if len(some) else ()):
                    least[:, k] = np.minimum.reduceat((hashes * a) >> np.uint64(32), first[some])
                pairs = least.astype(np.uint64)
                groups = mix((pairs[:, 0::2] << np.uint64(32)) | pairs[:, 1::2]).view(np.int64)
                cells = np.repeat(np.arange(hi - lo), np.diff(first)) * _PARITY + (hashes >> np.uint64(54)).astype(np.int64)
                odd = np.packbits(np.bincount(cells, minlength=(hi - lo) * _PARITY) & 1, bitorder="little")
                n, at = hi - lo, np.zeros(hi - lo, np.int64)
                at[some] = np.arange(len(some))
                blank = np.diff(first) == 0

                def per_row(values: np.ndarray, kind: pa.DataType) -> pa.Array:
                    full = values[at] if len(some) else np.zeros((n, values.shape[1]), values.dtype)
                    return _lists(full, values.shape[1], kind)

                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n),
                        batch.column("row").slice(lo, n),
                        pa.array(_nodes(hashes, first), pa.int64(), mask=blank),
                        pa.array(np.diff(first), pa.int64()),
                        per_row(groups[:, :side], pa.int64()),
                        per_row(groups[:, side:], pa.int64()),
                        _lists(odd.view(np.int64), _PARITY // 64, pa.int64()),
                    ],
                    names=["doc_id", "row", "node", "n_shingles", "first", "second", "sketch"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for lo, hi in slices(text):
                hashes, first = _shingle_sets(text.slice(lo, hi - lo), words)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(hashes, first)), lists], names=["node", "shingles"])

    return run


def _near_enough(x: str, y: str, percent: int) -> str:
    """SQL: whether the sketches and sizes of two classes, structs x and y, leave a link possible.

    With d the difference of the sets and s the sum of their sizes, a link needs d * (100 + p) <= s * (100 - p).
    """
    differ = " + ".join(f"bit_count({x}.sketch[{k}] ^ {y}.sketch[{k}])" for k in range(_PARITY // 64))
    return f"({differ}) * {100 + percent} <= ({x}.n_shingles + {y}.n_shingles) * {100 - percent}"


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets reach the similarity.

    The centre of a large bucket is in many pairs; both sides of each join are stored tables, so adaptive execution
    splits such a key's partition once it is large.
    """
    side = lambda name, to: classes.select(F.col("node").alias(name), F.struct("sketch", "n_shingles").alias(to))
    likely = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(_near_enough("x", "y", percent)).select("a", "b")
    both = F.size(F.array_intersect("x", "y")).cast("bigint")
    return (
        likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .where(100 * both >= percent * (F.size("x") + F.size("y") - both))
        .select("a", "b")
        .distinct()
    )


def _open_pairs(open_keys: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All pairs inside each bucket between classes of different components whose sketches leave a link possible."""
    shape = F.struct("sketch", "n_shingles")
    known = open_keys.select("key", "node", "label").join(classes.select("node", shape.alias("x")), "node")
    other = known.selectExpr("key", "node AS b", "label AS other", "x AS y")
    pairs = known.withColumnRenamed("node", "a").join(other, "key")
    return pairs.where(f"a < b AND label <> other AND {_near_enough('x', 'y', percent)}").select("a", "b")


def near_duplicates(
    docs: DataFrame, *, percent: int = 80, words: int = 5, side: int = 8, star_rounds: int = 2
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text; other columns ignored).

    Words are lower-cased in A-Z only. Null, empty and blank texts have no shingle, link with nothing and
    are kept; texts below `words` words are one shingle. Rows with equal sets are one class and are expanded only
    in the result, so repeated rows link without being paired. Inside a bucket every class is first held
    against the bucket's best-connected class; pairs are listed only between classes that are then still in
    different components and whose sketches leave a link possible. Equal doc_ids give a row each; the least doc_id of a
    component is its id. Rows without a doc_id link others as any row does; a component of such rows alone has no id.
    A text of any length is read whole, by itself where it is longer than a slice.
    """
    # a row is found again by a hash of its doc_id and text, so that rows without a doc_id are found too
    doc_id = F.col("doc_id").cast("bigint")
    texts = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, F.xxhash64("text")).alias("row"), "text")
    features = stored(texts.mapInArrow(_features(words, side), _FEATURES))
    classes = stored(
        features.where("node is not null")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first(F.struct("row", "n_shingles", "first", "second", "sketch")).alias("f"),
        )
        .select("node", "doc_id", "f.*")
    )
    cell = F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))
    keys = classes.select("node", "first", "second", cell.alias("cell")).select(
        "node",
        F.expr(f"xxhash64(cell, first[cell div {side}], second[cell % {side}])").alias("key"),
    )
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(keys.join(shared, "key"))
    near = members.groupBy("node").agg(F.sum("n").alias("weight"))
    wanted = classes.join(near, "node").select("row")
    again = texts.join(wanted.hint("shuffle_hash"), "row", "left_semi").select("text").mapInArrow(_sets(words), _SETS)
    sets = stored(again.dropDuplicates(["node"]))

    ranked = members.join(near, "node").select("key", "node", "weight")
    links, tried, old, labels = [], [], [], None
    for turn in range(star_rounds + 1):
        now = ranked.withColumn("label", F.col("node"))
        if labels is not None:
            now = ranked.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
        ends = now.groupBy("key").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("weight", "node", "label")).alias("top")
        )
        open_keys = stored(now.join(ends.where("low <> high"), "key").select("key", "node", "weight", "label", "top"))
        discard(*old)
        if turn < star_rounds:
            pairs = open_keys.where("label <> top.label").select(F.col("node").alias("a"), F.col("top.node").alias("b"))
        else:
            pairs = _open_pairs(open_keys, classes, percent)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = stored(pairs.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti") if tried else pairs)
        links.append(stored(_confirmed(pairs, classes, sets, percent)))
        tried.append(pairs)
        # what was held against its bucket's centre needs no second turn there
        ranked = open_keys.where("node <> top.node").select("key", "node", "weight")
        # before another star round labels only spare some work, so one step will do
        labels = stored(connected_components(reduce(DataFrame.unionByName, links), steps=1 if turn < star_rounds - 1 else None))
        old = [open_keys, labels]
    discard(sets, members, open_keys, *tried, *links)

    component = F.coalesce("component", "node")
    named = classes.select("node", "doc_id").join(labels, "node", "left").select("node", component.alias("component"), "doc_id")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = stored(named.join(least, "component").select("node", "component_id"))
    discard(classes, labels)
    linked = features.select("doc_id", "n_shingles", "node").join(of_class, "node", "left")
    return linked.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
