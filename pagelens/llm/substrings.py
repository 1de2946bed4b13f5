"""Removal of word sequences that repeat anywhere in a corpus, found through fixed-block anchors.

Any `window` consecutive words hold one whole block of (window + 1) // 2 words that starts at a multiple of the
block length, wherever the window starts. So only those non-overlapping blocks are indexed; every rolling
window of block length is a probe. Hits name the places to look at; there each hit is extended both ways by
comparing the full windows around it, and touching windows join into maximal repeats. Nothing is compared
pair by pair: hits and windows meet by content, so a passage in very many documents costs one row a place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.storage import discard, stored
from pagelens.llm.words import Words, slices

_RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _gathered(values: np.ndarray, owners: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Columns (value, key, keys) of (value, document key) pairs: values of one pair with key, others once with keys.

    Pairs of one slice are gathered before the shuffle, so that a passage in very many documents costs its tasks a row
    a slice.
    """
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(values), 1), bool), values[1:] != values[:-1]]))
    times = np.diff(np.append(first, len(values)))
    one, more = first[times == 1], first[times > 1]
    inside = np.repeat(times > 1, times)
    sizes = np.zeros(len(one) + len(more) + 1, np.int32)
    np.cumsum(times[times > 1], out=sizes[len(one) + 1 :])
    lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(owners[inside]), mask=pa.array(np.arange(len(sizes) - 1) < len(one)))
    key = pa.array(np.concatenate([owners[one], np.zeros(len(more), np.int64)]), mask=np.arange(len(sizes) - 1) >= len(one))
    return pa.array(np.concatenate([values[one], values[more]])), key, lists


def _blocks(block: int, aligned: bool):
    """(h, key, keys) rows, h a block hash: the indexed blocks, or the probes, which are all other windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, keys = batch.column("text"), np.asarray(batch.column("key"))
            for lo, hi in slices(text):
                table = Words(text.slice(lo, hi - lo))
                starts, doc = table.rolling(block)
                chosen = ((starts - table.first[:-1][doc]) % block == 0) == aligned
                starts, doc = starts[chosen], doc[chosen]
                # 48 bits only nominate a place; what is removed is decided on 64 bits of the whole window
                short = (table.windows(starts, block) >> np.uint64(16)).view(np.int64)
                yield pa.RecordBatch.from_arrays(list(_gathered(short, keys[lo:hi][doc])), names=["h", "key", "keys"])

    return run


def _candidates(block: int, window: int):
    """Hashes of the full windows around each hit, with their number in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, keys, hits = batch.column("text"), np.asarray(batch.column("key")), batch.column("hits")
            for lo, hi in slices(text):
                table = Words(text.slice(lo, hi - lo))
                starts, doc = table.rolling(block)
                short = (table.windows(starts, block) >> np.uint64(16)).view(np.int64)
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                found, owner = [], []
                for d in range(hi - lo):
                    n = table.first[d + 1] - table.first[d]
                    if n < window:
                        continue
                    at = np.flatnonzero(np.isin(short[cuts[d] : cuts[d + 1]], np.asarray(hits[lo + d].values)))
                    reach = np.zeros(n + 1, np.int64)
                    np.add.at(reach, np.maximum(at - (window - block), 0), 1)
                    np.add.at(reach, at + 1, -1)
                    near = np.flatnonzero(np.cumsum(reach)[: n - window + 1] > 0)
                    values, times = np.unique(table.windows(table.first[d] + near, window).view(np.int64), return_counts=True)
                    found.append((values, times))
                    owner.append(np.full(len(values), keys[lo + d]))
                if found:
                    values, times = (np.concatenate(x) for x in zip(*found, strict=True))
                    w, key, several = _gathered(values, np.concatenate(owner))
                    # the sum of a value's starts over the slice, in the order of `w`
                    sums = np.bincount(np.searchsorted(np.sort(w.to_numpy()), values), times, len(w)).astype(np.int64)
                    n = sums[np.searchsorted(np.sort(w.to_numpy()), w.to_numpy())]
                    yield pa.RecordBatch.from_arrays([w, key, several, pa.array(n)], names=["w", "key", "keys", "n"])

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, repeats = batch.column("text"), batch.column("repeats")
            marked = np.asarray(repeats.is_valid())
            for lo, hi in slices(text):
                table = Words(text.slice(lo, hi - lo))
                raw, removed, digest = table.data.tobytes(), [], []
                for d in range(hi - lo):
                    words = raw[table.offsets[d] : table.offsets[d + 1]].split()
                    n, gone = len(words), 0
                    if n >= window and marked[lo + d]:
                        hashes = table.windows(np.arange(table.first[d], table.first[d + 1] - window + 1), window)
                        at = np.flatnonzero(np.isin(hashes.view(np.int64), np.asarray(repeats[lo + d].values)))
                        cover = np.zeros(n + 1, np.int64)
                        cover[at] += 1
                        cover[at + window] -= 1
                        stay = np.cumsum(cover)[:n] == 0
                        gone = n - int(stay.sum())
                        words = [words[i] for i in np.flatnonzero(stay)]
                    removed.append(gone)
                    digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(table.counts(), pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(digest, pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return run


def repeated_windows(docs: DataFrame, window: int = 35) -> DataFrame:
    """(key, repeats): per document with repeats, the hashes of its windows that also start elsewhere.

    `docs` has key (bigint, not null; equal rows may share it) and text. The tables that joins meet are stored first, so
    that both sides of a join are plain shuffles, which adaptive execution may split where a hash is very frequent.
    """
    block = (window + 1) // 2
    rows = "h bigint, key bigint, keys array<bigint>"
    each = F.explode(F.coalesce("keys", F.array("key"))).alias("key")
    indexed = docs.mapInArrow(_blocks(block, True), rows)
    anchors = stored(indexed.groupBy("h").agg(F.sum(F.when(F.col("keys").isNull(), 1).otherwise(F.size("keys"))).alias("n")))
    probes = docs.mapInArrow(_blocks(block, False), rows)
    outside = stored(probes.join(anchors.select("h").hint("shuffle_hash"), "h"))
    again = stored(anchors.where("n > 1").select("h").unionByName(outside.select("h")).distinct())
    inside = indexed.join(again.hint("shuffle_hash"), "h", "left_semi")
    hits = stored(outside.unionByName(inside).select("h", each).groupBy("key").agg(F.collect_set("h").alias("hits")))
    discard(anchors, outside, again)
    places = docs.join(hits, "key").mapInArrow(_candidates(block, window), "w bigint, key bigint, keys array<bigint>, n bigint")
    windows = stored(places)
    discard(hits)
    repeated = stored(windows.groupBy("w").agg(F.sum("n").alias("times")).where("times > 1").select("w"))
    result = stored(windows.join(repeated, "w").select("w", each).groupBy("key").agg(F.collect_set("w").alias("repeats")))
    discard(windows, repeated)
    return result


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of `docs` (doc_id, text; other columns ignored).

    Every word under a window of `window` words that also starts elsewhere, in this or any document, is removed;
    windows are judged on the input. Null and empty texts have no words; rows that repeat a document
    repeat its windows. Documents below `window` words lose nothing. Null doc_ids are rows like others. A text of any
    length is read whole, by itself where it is longer than a slice.
    """
    doc_id, text = F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit(""))
    # rows without a doc_id are told apart by their texts
    texts = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, F.xxhash64(text)).alias("key"), text.alias("text"))
    repeats = repeated_windows(texts.select("key", "text"), window)
    return texts.join(repeats, "key", "left").select("doc_id", "text", "repeats").mapInArrow(_kept(window), _RESULT)
