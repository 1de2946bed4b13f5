"""Packing of tokenised documents into sequences of bounded length, planned over their lengths.

Only lengths matter for packing, and there are no more of them than a sequence has tokens, so the plan is made over counts
by length: sums of one, two and three lengths are indexed, combinations that fill a gap exactly are consumed as often as
their counts allow, and gaps without one take the length that fits best. The plan is a short table of patterns and how
often each is used; a piece finds its sequence and place by its number among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.storage import stored

LIMIT, END = 2048, 0
#: The code points that are white space in Unicode; a token of the vocabulary never goes on from others to these.
_SPACE = r" \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BREAK = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
#: The cut that the vocabulary's byte-level pre-tokenizer makes; a fixed value.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLOCK = 1 << 20
_END_BITS = 44  # bits of a number among the pieces of one length


def byte_bpe(path: str):
    """An encoder for a byte-level vocabulary file whose merges are in the order of their ids, so that ids are ranks."""
    import tiktoken

    from pagelens.llm.bpe import byte_letters

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("the vocabulary's ids are not in the order of its merges")
    byte = {letter: b for b, letter in enumerate(byte_letters())}
    ranks = {bytes(map(byte.__getitem__, token)): k for token, k in vocab.items() if token not in special}
    return tiktoken.Encoding(path, pat_str=_WORDS, mergeable_ranks=ranks, special_tokens=special)


class ByteBpe:
    """Encodes texts of any length as the tokenizers library does, specials named in them included."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.bpe, self.library = byte_bpe(path), Tokenizer.from_file(path)

    def _block(self, text: str) -> bytes:
        try:
            ids = self.bpe.encode_to_numpy(text, allowed_special=self.bpe.special_tokens_set)
        except ValueError:  # its patterns run out of stack on very long white space
            ids = np.array(self.library.encode(text, add_special_tokens=False).ids)
        return ids.astype("<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian numbers of four bytes; a long text is taken about a megabyte at a time."""
        found, at = [], 0
        while at < len(text):
            end = _BREAK.search(text, at + _BLOCK) if len(text) - at > _BLOCK else None
            stop = end.start() if end else len(text)
            found.append(self._block(text[at:stop]))
            at = stop
        return b"".join(found)


_loaded: dict[str, ByteBpe] = {}


def _pieces(path: str, limit: int, end: int, keep_ids: bool):
    closing = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded.get(path) or _loaded.setdefault(path, ByteBpe(path))
        part, seen = TaskContext.get().partitionId(), [0] * (limit + 1)
        for batch in batches:
            rows, ids = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                packed = bpe.encode(text.as_py() or "") + closing
                size = len(packed) // 4
                start, piece, length = 0, 0, (size - 1) % limit + 1
                while start < size:
                    own = packed[4 * start : 4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), seen[length]))
                    if keep_ids:
                        ids.append(np.frombuffer(own, "<i4"))
                    seen[length] += 1
                    start, piece, length = start + length, piece + 1, limit
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.array([part] * len(rows), pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_nth", "_part"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def token_pieces(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, _nth, _part and, if asked, ids, for every piece of every row of `docs`.

    A document's ids are those of its text with `end` after them. One of more than `limit` ids is cut into pieces of
    `limit`, of which the first may be shorter. _nth numbers the pieces of one length within their task, _part.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, _nth bigint, _part int" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_pieces(path, limit, end, keep_ids), schema)


class SumIndex:
    """How many multisets of one, two and three available lengths have each sum.

    A length counts at most three times, as often as it is available. Taking a length out, or putting it in, shifts and
    adds whole arrays of sums.
    """

    def __init__(self, limit: int):
        self.left = np.zeros(limit + 1, np.int64)
        self.sums = np.zeros((4, limit + 1), np.int64)  # by number of lengths
        self.sums[0, 0] = 1

    def _change(self, length: int, level: int, sign: int) -> None:
        """Take the multisets with `length`, available `level` times, out of the sums (-1) or put them in (1)."""
        size = self.sums.shape[1]
        for several in (1, 2, 3) if sign < 0 else (3, 2, 1):
            for copies in range(1, min(level, several) + 1):
                if copies * length < size:
                    self.sums[several, copies * length :] += sign * self.sums[several - copies, : size - copies * length]

    def set(self, length: int, available: int) -> None:
        before, after = min(int(self.left[length]), 3), min(available, 3)
        self.left[length] = available
        if before != after:
            self._change(length, before, -1)
            self._change(length, after, 1)

    def take(self, length: int, times: int = 1) -> None:
        self.set(length, int(self.left[length]) - times)

    def _pair(self, total: int) -> list[int] | None:
        low = np.arange(1, total // 2 + 1)
        there = (self.left[low] > 0) & (self.left[total - low] > np.where(2 * low == total, 1, 0))
        found = int(np.argmax(there)) if len(low) else 0
        return [total - int(low[found]), int(low[found])] if len(low) and there[found] else None

    def exact(self, gap: int, most: int = 3) -> list[int]:
        """Up to `most` (1 to 3) available lengths that add up to `gap`, as few and as unequal as can be; none gives []."""
        if gap < 1:
            return []
        if self.sums[1, gap]:
            return [gap]
        if most > 1 and self.sums[2, gap]:
            return self._pair(gap)
        if most > 2 and self.sums[3, gap]:
            first = np.arange(gap - 1, 0, -1)
            for a in first[(self.left[first] > 0) & (self.sums[2, gap - first] > 0)]:
                self.left[a] -= 1
                rest = self._pair(gap - int(a))
                self.left[a] += 1
                if rest:
                    return [int(a), *rest]
        return []

    def best_fit(self, gap: int) -> list[int]:
        """The available length that leaves the least of a gap; none gives []."""
        return [int(x) for x in np.flatnonzero(self.left[: gap + 1])[-1:]]


def plan(counts: dict[int, int], limit: int, most: int = 3) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) patterns that use up `counts` of lengths, none longer than `limit` together.

    From the longest on, each length is filled up to `limit`: by at most `most` others that fill its gap exactly, else by the
    one that fits best, and so on with the gap that this leaves. A pattern is used as often as its counts allow.
    """
    index, found = SumIndex(limit), []
    for length, count in counts.items():
        index.set(length, count)
    for length in range(limit, 0, -1):
        while index.left[length]:
            pattern, gap, more = [], limit, [length]
            while more:
                for x in more:
                    index.take(x)
                pattern += more
                gap -= sum(more)
                more = index.exact(gap, most) or index.best_fit(gap)
            copies = Counter(pattern)
            again = min(int(index.left[x]) // c for x, c in copies.items())
            for x, c in copies.items():
                index.take(x, again * c)
            found.append((again + 1, dict(sorted(copies.items(), reverse=True))))
    return found


def best_plan(counts: dict[int, int], limit: int) -> list[tuple[int, dict[int, int]]]:
    """The plan of fewest sequences among those that combine up to three, up to two and single lengths."""
    return min((plan(counts, limit, most) for most in (3, 2, 1)), key=lambda patterns: sum(times for times, _ in patterns))


@dataclass
class Places:
    """For each pattern and length, in order of length and number: where the pattern's pieces of that length go."""

    keys: np.ndarray  # length and number of the first piece
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and numbers among their length."""
        key = (length << _END_BITS) + number
        at = np.searchsorted(self.keys, key, "right") - 1
        within, copies = key - self.keys[at], self.copies[at]
        return self.sequence[at] + within // copies, self.offset[at] + within % copies * length


def places(patterns: list[tuple[int, dict[int, int]]]) -> Places:
    """Gives the pieces of each length, by number, to the patterns in turn."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for times, copies in patterns:
        offset = 0
        for length, c in copies.items():
            rows.append(((length << _END_BITS) + used[length], c, sequence, offset))
            used[length] += times * c
            offset += length * c
        sequence += times
    return Places(*np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """`pieces` (as of `token_pieces`, stored so that they stay the same) with sequence_id and offset.

    The driver plans over one count for each length up to `limit`, and sends tasks a table of patterns that depends on `limit`
    alone: each use of a length leaves fewer pieces of it than the pattern holds.
    """
    here = pieces.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in here.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    where = pieces.sparkSession.sparkContext.broadcast(places(best_plan(counts, limit)))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = here.select("_part", "length", (F.sum("_n").over(earlier) - F.col("_n")).alias("_first"))
    numbered = pieces.join(starts, ["_part", "length"]).withColumn("_number", F.col("_first") + F.col("_nth"))
    kept = [c for c in pieces.columns if c not in ("_nth", "_part")]
    numbered = numbered.select(*kept, "_number")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (np.asarray(batch.column(c), np.int64) for c in ("length", "_number"))
            sequence, offset = where.value.of(length, number) if len(length) else (length, number)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kinds = dict(numbered.dtypes)
    return numbered.mapInArrow(placed, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every row of `docs` (doc_id, text).

    A null text counts as empty: one piece, of the id `end` alone. Repeated rows and rows without a doc_id are documents of
    their own. A text of any length is encoded whole, a megabyte at a time. Other columns are ignored; an empty table gives
    an empty one. `path` names the vocabulary file, which every executor must have.
    """
    return pack(stored(token_pieces(docs, path, limit, end, keep_ids)), limit)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the token ids of each sequence and the document of each of its pieces, from pieces that kept their ids.

    A group is one sequence, so it never holds more tokens than the limit.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("_p")).select("sequence_id", F.flatten("_p.ids").alias("ids"), F.col("_p.doc_id").alias("doc_ids"))
