"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document is the vector of all its hashed character n-grams, each the square root of its share of all. Every n-gram is
a feature, scaled by the log ratio between its smoothed weights in toxic and in clean training documents; a regularised
logistic regression on them gives the final weights. It is fitted on a bounded sample of labelled rows and applied to
every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.storage import discard, stored

#: Hash buckets for n-grams (a power of two) and their lengths in characters, blanks between words included.
BUCKET_BITS, LENGTHS = 18, (3, 4, 5, 6)
#: The classifier is fitted on at most this many labelled rows of each class, the least by a hash of doc_id.
ROWS_PER_CLASS = 1500
#: Average n-grams that smooth the weights of the smaller class.
PRIOR = 0.3
#: Parts in which the training rows come to the driver.
PARTS = 8
#: Entries of training rows that the fit works on together.
ENTRIES = 1 << 20
#: Places of a text that are looked at together.
PLACES = 1 << 16

_SCORED = "doc_id bigint, held_out boolean, score double, predicted int"

#: ASCII characters that are neither letter nor digit count as blanks.
_ASCII = np.array([b if chr(b).isalnum() else 32 for b in range(128)], np.uint32)


def characters(text: str | None) -> np.ndarray:
    """Code points of a text in lower case, its runs of ASCII punctuation and white space as one blank, blanks around it."""
    x = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(x < 128, _ASCII[np.minimum(x, 127)], x)
    return x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]


def _starting(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The bucket of every n-gram of characters `x` that starts at a place from lo up to hi."""
    found, packed = [], x[lo:hi]
    for n in range(2, max(LENGTHS) + 1):
        size = min(hi, len(x) - n + 1) - lo
        if size <= 0:
            break
        packed = packed[:size] * np.uint32(0x9E3779B1) + x[lo + n - 1 : lo + n - 1 + size]
        if n in LENGTHS:
            mixed = (packed ^ (packed >> np.uint32(15))) * np.uint32(0x85EBCA77)
            found.append(mixed >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, of so many places at a time that a long text needs no more memory than a short one."""
    x = characters(text)
    for lo in range(0, len(x), PLACES):
        yield _starting(x, lo, min(lo + PLACES, len(x)))


def buckets(text: str | None) -> np.ndarray:
    """The bucket of every n-gram of the text, at every place, repeats included."""
    return np.concatenate(list(pieces(text)))


def shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets, and the square root of each one's share."""
    found = pieces(text)
    first, second = next(found), next(found, None)
    if second is None:
        ids, times = np.unique(first, return_counts=True)
    else:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for x in chain((first, second), found):
            total += np.bincount(x, minlength=len(total))
        ids = np.flatnonzero(total)
        times = total[ids]
    return ids.astype(np.int32), np.sqrt(times / max(times.sum(), 1))


@dataclass(frozen=True)
class Model:
    """A weight for every bucket of n-grams."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        ids, values = shares(text)
        z = self.bias + float(values @ self.weights[ids])
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def log_ratios(sums: pd.DataFrame, toxic_rows: int, clean_rows: int, smoothing: float | tuple[float, float]) -> np.ndarray:
    """Log of an n-gram's smoothed weight a toxic row over its weight a clean row, for rows (toxic, clean); the smoothing may differ by class."""
    prior = smoothing if isinstance(smoothing, tuple) else (smoothing, smoothing)
    toxic, clean = (sums[c].to_numpy(float) + p for c, p in zip(("toxic", "clean"), prior))
    return np.log((toxic / toxic_rows) / (clean / clean_rows))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, toxic, clean, n_rows) over a task's rows: sums of shares by class, and rows that hold the bucket."""
    size = 1 << BUCKET_BITS
    total = np.zeros((3, size))
    for batch in batches:
        for y, ids, values in zip(batch.column("toxic"), batch.column("buckets"), batch.column("shares"), strict=True):
            at = np.asarray(ids.values)
            total[0 if y.as_py() else 1, at] += np.asarray(values.values)
            total[2, at] += 1
    at = np.flatnonzero(total[2])
    yield pa.RecordBatch.from_arrays(
        [pa.array(at.astype(np.int32)), *(pa.array(total[k, at]) for k in range(3))], names=["bucket", "toxic", "clean", "n_rows"]
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for y, text in zip(batch.column("toxic"), batch.column("text"), strict=True):
            ids, values = shares(text.as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array([y.as_py()], pa.int32()), pa.array([ids], pa.list_(pa.int32())), pa.array([values.astype(np.float32)], pa.list_(pa.float32()))],
                names=["toxic", "buckets", "shares"],
            )


def fit(
    labels: np.ndarray, starts: np.ndarray, at: np.ndarray, scaled: np.ndarray, size: int,
    rounds: int = 100, ridge: float = 5e-4, rate: float = 0.05, balance: float = 0.5,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by Adam steps; row k's entries (feature, value) begin at starts[k], none is empty.

    A row counts as the share of its class to the power -balance. A step goes over whole rows of about ENTRIES entries at a
    time.
    """
    parts = np.bincount(labels.astype(int), minlength=2) / len(labels)
    counts = np.maximum(parts, 1e-9)[labels.astype(int)] ** -balance
    counts /= counts.sum()
    beta, bias = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    ends = np.append(starts[1:], len(at))
    cuts = [0, *(int(k) for k in np.unique(np.searchsorted(ends, np.arange(ENTRIES, len(at), ENTRIES), "left") + 1) if k < len(labels)), len(labels)]
    for t in range(1, rounds + 1):
        g, gb = ridge * beta, 0.0
        for a, b in zip(cuts, cuts[1:]):
            part = slice(starts[a], ends[b - 1])
            z = np.add.reduceat(scaled[part] * beta[at[part]], starts[a:b] - starts[a]) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels[a:b]) * counts[a:b]
            g += np.bincount(at[part], scaled[part] * np.repeat(error, ends[a:b] - starts[a:b]), size)
            gb += error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        beta -= rate * m / a / (np.sqrt(v / b) + 1e-8)
        bias -= rate * mb / a / (np.sqrt(vb / b) + 1e-8)
    return beta, float(bias)


def _entries(rows: DataFrame, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(labels, starts, features, scaled values) of all rows that are not empty, in an order of their own; fetched in PARTS."""
    own = F.xxhash64("buckets", "shares")
    some = rows.where(F.size("buckets") > 0)
    entries = some.agg(F.sum(F.size("buckets"))).first()[0] or 0
    at, scaled, labels, lengths, filled = np.empty(entries, np.int32), np.empty(entries, np.float32), [], [], 0
    for part in range(PARTS):
        for batch in some.where(F.pmod(own, F.lit(PARTS)) == part).orderBy(own, "toxic").toArrow().to_batches():
            ids, values = batch.column("buckets"), batch.column("shares")
            lo, hi = ids.offsets[0].as_py(), ids.offsets[-1].as_py()
            room = slice(filled, filled + hi - lo)
            at[room] = np.asarray(ids.values)[lo:hi]
            scaled[room] = np.asarray(values.values)[lo:hi] * factor[at[room]]
            filled = room.stop
            labels.append(np.asarray(batch.column("toxic"), float))
            lengths.append(np.diff(ids.offsets.to_numpy()))
    sizes = np.concatenate(lengths) if lengths else np.empty(0, int)
    return np.concatenate(labels) if labels else np.empty(0), (np.cumsum(sizes) - sizes).astype(np.int64), at, scaled


def held_out(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Fit on labelled documents outside the held-out fold.

    Null labels and labels other than 0 and 1 are left out; a document labelled both ways counts as toxic. The sample's
    ids are at most 2 * rows_per_class, so they are broadcast to the scan of `docs`; of several texts under one doc_id
    the least is taken. Sums by bucket and the distinct n-grams of these rows reach the driver. Without both classes every
    text scores the labels' share.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(rows_per_class) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(sample, "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    rows = stored(rows.mapInArrow(_features, "toxic int, buckets array<int>, shares array<float>"))
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    size = 1 << BUCKET_BITS
    if len(n) < 2:
        share = float(np.clip(max(n, default=0), 1e-6, 1 - 1e-6))
        discard(rows)
        return Model(np.zeros(size), float(np.log(share / (1 - share))))
    each = rows.mapInArrow(_sums, "bucket int, toxic double, clean double, n_rows double").groupBy("bucket")
    sums = each.agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "n_rows"))).toPandas()
    # PRIOR average n-grams of a row in the smaller class, and as much a row in the other: one never seen speaks for neither
    average = (sums["toxic"].sum() + sums["clean"].sum()) / max(sums["n_rows"].sum(), 1)
    smoothing = tuple(PRIOR * average * k / min(n.values()) for k in (n[1], n[0]))
    factor = np.zeros(size)
    factor[sums["bucket"]] = 10 * log_ratios(sums, n[1], n[0], smoothing)
    labels, starts, at, scaled = _entries(rows, factor.astype(np.float32))
    discard(rows)
    beta, bias = fit(labels, starts, at, scaled, size)
    return Model(factor * beta, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text; other columns ignored).

    The whole text is scored, of any length. Null and empty texts have no n-gram, so their score is that of the bias;
    repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores = np.array([known.score(text.as_py()) for text in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(scores),
                    pa.array((scores >= 0.5).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return texts.mapInArrow(run, _SCORED)


def rejected(docs: DataFrame, model: Model, threshold: float = 0.5) -> F.Column:
    """A predicate on `text`: true where the model scores at least `threshold`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def is_toxic(texts: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([known.score(t) >= threshold for t in texts], index=texts.index, dtype=bool)

    return is_toxic("text")
