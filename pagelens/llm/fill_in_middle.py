"""Fill-in-the-middle rearrangement, with token boundaries in succinct bitvectors.

A slice of texts is one bitvector with a bit at the last byte of every token, packed eight to a byte, and a directory of
popcounts by block. A text's tokens are counted by the rank of its two ends; the token after which it is cut is found by
select. Code points are counted by rank over a second bitvector, of the bytes that begin one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.words import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_BLOCK = 512  # bits of a block of the directory
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class BitVector:
    """Packed bits under a directory that holds, for each block, the bits set before it."""

    def __init__(self, bits: np.ndarray):
        blocks = len(bits) // _BLOCK + 1  # the position after the last bit has a block, too
        packed = np.zeros(blocks * _BLOCK // 8, np.uint8)
        packed[: (len(bits) + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8").reshape(blocks, -1)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Bits set in front of each position."""
        block, word, bit = at // _BLOCK, at % _BLOCK // 64, (at % 64).astype(np.uint64)
        counts = np.bitwise_count(self.words[block]).astype(np.int64)
        counts[np.arange(8)[None, :] >= word[:, None]] = 0
        part = self.words[block, word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + counts.sum(1) + np.bitwise_count(part)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th set bit, counted from 1."""
        block = np.searchsorted(self.before, k) - 1
        upto = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        left = k - self.before[block]
        word = (upto < left[:, None]).sum(1)
        row = np.arange(len(k))
        left = left - np.where(word > 0, upto[row, word - 1], 0)
        bits = np.unpackbits(np.ascontiguousarray(self.words[block, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * _BLOCK + word * 64 + (np.cumsum(bits, axis=1) < left[:, None]).sum(1)


def token_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each byte is its token's last: a solid byte before white space, or a text's last byte of any kind."""
    ends = np.zeros(len(data), bool)
    if len(data):
        space = _SPACE[data]
        ends[:-1] = ~space[:-1] & space[1:]
        ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return ends


def _cut(column: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bytes, and for each text of the slice where it starts, is cut twice and ends; its tokens; code points of prefix and middle."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    data = np.frombuffer(column.buffers()[2], np.uint8, size, at) if size else np.empty(0, np.uint8)
    offsets = offsets - at
    tokens = BitVector(token_ends(data, offsets))
    passed = tokens.rank(offsets)
    n = np.diff(passed)
    a, b = first % (n + 1), second % (n + 1)
    cuts = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        cut = offsets[:-1].copy()
        some = k > 0
        cut[some] = tokens.select(passed[:-1][some] + k[some]) + 1
        cuts.append(cut)
    letters = BitVector((data & 0xC0) != 0x80)
    start, low, high = (letters.rank(x) for x in (offsets[:-1], *cuts))
    return data, offsets, *cuts, n, low - start, high - low


def _rearranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        draws = [np.asarray(batch.column(c), np.int64) for c in ("_first", "_second", "_third", "_fourth")]
        for lo, hi in slices(texts):
            part = texts.slice(lo, hi - lo)
            first, second, plain, spm = (d[lo:hi] for d in draws)
            data, offsets, low, high, n, prefix, middle = _cut(part, first, second)
            whole, form, output = data.tobytes(), [], []
            for k in range(hi - lo):
                a, b, c, d = int(offsets[k]), int(low[k]), int(high[k]), int(offsets[k + 1])
                marked = any(whole.find(m, a, d) >= 0 for m in (b"<P>", b"<S>", b"<M>"))
                if plain[k] or marked or a == d:
                    form.append("plain")
                    output.append(whole[a:d])
                elif spm[k]:
                    form.append("spm")
                    output.append(b"".join((b"<S>", whole[c:d], b"<P>", whole[a:b], b"<M>", whole[b:c])))
                else:
                    form.append("psm")
                    output.append(b"".join((b"<P>", whole[a:b], b"<S>", whole[c:d], b"<M>", whole[b:c])))
            kept = np.array([f == "plain" for f in form], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(prefix, pa.int64(), mask=kept),
                    pa.array(middle, pa.int64(), mask=kept),
                    pa.array(output, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of `docs` (doc_id, text).

    Tokens are runs of solid characters with the white space before them, and white space that ends a text; n is their
    number. Of 100 texts about `rate` are cut at two of the n + 1 places between tokens and rearranged, `spm` of 100 of
    these as suffix, prefix, middle and the others as prefix, suffix, middle; which ones and where is drawn by a hash of
    `seed` and doc_id, so that repeated rows get equal outputs. A null text counts as empty; empty texts and those that
    hold a marker stay plain, and their prefix_chars and middle_chars are null. A row without a doc_id draws as if its id
    were empty. A text of any length is cut whole, by itself; columns other than the two are ignored.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")
    asked = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), draw(0).alias("_first"), draw(1).alias("_second"),
        (draw(2) % 100 >= rate).cast("bigint").alias("_third"), (draw(3) % 100 < spm).cast("bigint").alias("_fourth"),
    )
    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return asked.mapInArrow(_rearranged, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that `fill_in_middle` rearranged, from its output and form alone; a null output gives null."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).when(form == "plain", output)
    )


def digests(rearranged: DataFrame) -> DataFrame:
    """The rows of `fill_in_middle` with the digests of the output and of the text restored from it, in place of the output."""
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return rearranged.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


#: DuckDB SQL for the digests with the parameters' defaults.
ORACLE = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
