"""Importance resampling of documents towards a target corpus, over hashed runs of words.

One scan of a text keeps a ring of CRC states, one for each of the last few words at which a run may have begun; a word
extends every state in it by a space and itself, so that a run's checksum costs its last word only. Runs are counted in a
fixed number of buckets; a bucket's gain is the log of its share among the targets over its share among the documents.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.storage import stored

BUCKETS, LONGEST, SEED = 10_000, 3, 42

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of a text that are split into words at once.
_BLOCK = 1 << 20
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a lower-cased text, some at a time, however long it is."""
    at = 0
    while at < len(data):
        end = _BREAK.search(data, at + _BLOCK)
        stop = end.start() if end else len(data)
        yield _WORD.findall(data, at, stop)
        at = stop


def scan(text: str, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """Number of words, and the CRC-32 of every run of 1 to `longest` consecutive words joined by spaces."""
    crc, found, n = zlib.crc32, array("I"), 0
    ring: list[int] = []  # states of the runs that end in the last word, longest first
    for words in _words(text.encode().lower()):
        n += len(words)
        for word in words:
            extended = b" " + word
            ring = [crc(extended, state) for state in ring[max(0, len(ring) + 1 - longest) :]]
            ring.append(crc(word))
            found.extend(ring)
    return n, np.frombuffer(found, np.uint32) if found else np.empty(0, np.uint32)


def _counts(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                _, runs = scan(text.as_py() or "", longest)
                total += np.bincount(runs % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): how many runs of all texts fall into each bucket; each task adds its own up before the shuffle."""
    return texts.select("text").mapInArrow(_counts(buckets, longest), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed document share) of each bucket.

    The driver holds one number for each of `buckets` buckets, whatever the size of the tables.
    """
    s, t = (bucket_counts(x, buckets, longest).withColumnRenamed("n", name) for x, name in ((docs, "s"), (targets, "t")))
    both = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    rows = both.collect()
    found = np.zeros((2, buckets))
    for bucket, a, b in rows:
        found[0, bucket], found[1, bucket] = a, b
    source, target = found
    shares = ((target + 1) * (source.sum() + buckets)) / ((source + 1) * (target.sum() + buckets))
    return np.floor(1000 * np.log(shares)).astype(np.int64)


def _weights(gains: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.uint32(len(gains))
        for batch in batches:
            words, features, weights = [], [], []
            for text in batch.column("text"):
                n, runs = scan(text.as_py() or "", longest)
                words.append(n)
                features.append(len(runs))
                weights.append(int(gains[runs % buckets].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, features, weights))], names=["doc_id", "n_words", "n_features", "weight"]
            )

    return run


def importance_weights(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row of `docs`: the sum of the gains of its runs."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(_weights(gains, longest), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u drawn from (0, 1) by a hash of `seed` and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u)))


def ranked(scored: DataFrame, percent: int, eligible: Column) -> DataFrame:
    """`scored` (doc_id, score and others) with rank: 1, 2, 3... for the floor(percent N / 100) highest scores of the N eligible rows.

    Ties go to the smaller doc_id, then rows without one, repeated rows in any order. Tasks sort ranges of the order; the driver's
    and the broadcast's part is one count for each of them.
    """
    # a place of its own for each row lets ranges cut through rows alike in everything; stored, it stays the same
    rows = stored(scored.withColumns({"_place": F.monotonically_increasing_id(), "_asked": eligible}))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_place")]
    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.where("_asked").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # in sorted partitions this id is the partition's number and the row's place in it
    placed = stored(asked.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = F.when(rank <= F.floor(F.col("_all") * percent / 100), rank)
    kept = scored.columns
    return numbered.select(*kept, drawn.alias("rank")).unionByName(rows.where("NOT _asked").select(*kept, F.lit(None).cast("bigint").alias("rank")))


def resampled(docs: DataFrame, targets: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of `docs` (doc_id, text), drawn towards `targets` (text).

    Words are runs of ASCII letters and digits, A to Z lower-cased, and of code points above ASCII; features are the runs
    of 1 to `longest` words, by the bucket of their checksum. Documents of `least_words` words or more are drawn without
    replacement in proportion to their weight's exponential, by Gumbel noise on a scale of a thousandth. Null texts hold
    no words: weight 0. Repeated rows each have their row; without targets every bucket's share there is equal. Texts of any length are scanned whole, a
    megabyte at a time. Other columns are ignored, and an empty table gives an empty one.
    """
    gains = bucket_gains(docs, targets, buckets, longest)
    scored = importance_weights(docs, gains, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return ranked(scored, percent, F.col("n_words") >= least_words).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose doc_id is drawn by `resampled`; rows without a doc_id are not."""
    chosen = resampled(docs, targets, **options).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(chosen.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)
