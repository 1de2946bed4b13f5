"""Byte-level BPE with word ends, encoding each word over a contiguous array of adjacent-pair ranks.

A short word is held as part boundaries beside the rank of every adjacent pair; the smallest rank is found by
a scan, its inner boundary is deleted and the two neighbouring ranks are refreshed. Long words, for which
repeated scans would be quadratic, keep the same ranks in a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of more symbols than this use the heap.
SCAN_LIMIT = 96
#: Distinct pieces of text whose result a worker remembers before it starts again.
REMEMBERED = 200_000

_NEVER = 1 << 60
_NOT_SPACE = regex.compile(r"[^\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROL = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary file with merges and an end-of-word suffix.

    A pair of parts is the number left << 16 | right; its entry is rank << 17 | merged, so the least entry of a
    row is the pair to merge next and names the part it becomes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if max(vocab.values(), default=0) >= 1 << 16:
            raise ValueError("ids of 65536 and above do not fit a packed pair")
        self.entries = {vocab[a] << 16 | vocab[b]: k << 17 | vocab[a + b] for k, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self.inner = [vocab[c] for c in byte_letters()]
        self.last = [vocab[c + end] for c in byte_letters()]
        self.piece = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.marker = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

    def word(self, piece: str) -> list[int]:
        """The ids of one word."""
        raw = piece.encode()
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        if len(parts) > SCAN_LIMIT:
            return self._long_word(parts)
        entry = self.entries.get
        near = [entry(a << 16 | b, _NEVER) for a, b in zip(parts, parts[1:])]
        while near:
            least = min(near)
            if least == _NEVER:
                break
            i = near.index(least)
            parts[i] = merged = least & 0x1FFFF
            del parts[i + 1], near[i]
            if i:
                near[i - 1] = entry(parts[i - 1] << 16 | merged, _NEVER)
            if i < len(near):
                near[i] = entry(merged << 16 | parts[i + 1], _NEVER)
        return parts

    def _long_word(self, parts: list[int]) -> list[int]:
        n, entries = len(parts), self.entries
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        pairs = [a << 16 | b for a, b in zip(parts, parts[1:])]
        heap = [(entries[p], i, p) for i, p in enumerate(pairs) if p in entries]
        heapq.heapify(heap)
        while heap:
            found, i, pair = heapq.heappop(heap)
            j = right[i]
            if j < 0 or parts[i] << 16 | parts[j] != pair:
                continue
            parts[i], parts[j] = found & 0x1FFFF, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (p := parts[k] << 16 | parts[right[k]]) in entries:
                    heapq.heappush(heap, (entries[p], k, p))
        return [p for p in parts if p >= 0]

    def pieces(self, chunk: str) -> list[str]:
        """The words of a text without white space or special tokens, as the vocabulary spells them."""
        # each letter is lowered by itself: no special form for a sigma that ends a word
        plain = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")).lower()
        if plain.isalpha():
            return [plain]
        if plain[:-1].isalpha():
            return [plain[:-1], plain[-1]]
        return self.piece.findall(plain)

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space; special tokens stand alone."""
        if "<|" in text and self.marker.search(text):
            found, at = [], 0
            for m in self.marker.finditer(text):
                found += [*_NOT_SPACE.findall(text[at : m.start()]), m[0]]
                at = m.end()
            return found + _NOT_SPACE.findall(text[at:])
        return _NOT_SPACE.findall(text) if _CONTROL.search(text) else text.split()

    def encode(self, text: str) -> list[int]:
        found: list[int] = []
        for chunk in self.chunks(text):
            if chunk in self.special:
                found.append(self.special[chunk])
            else:
                for piece in self.pieces(chunk):
                    found += self.word(piece)
        return found

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one blank, special ones included; the vocabulary names no decoder of its own."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


class _Remembered(dict):
    """Packed ids and decoded bytes of each piece of text seen lately."""

    def __init__(self, bpe: WordBpe, most: int = REMEMBERED):
        super().__init__()
        self.bpe, self.most = bpe, most
        self.words: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        bpe, packed = self.bpe, b""
        if chunk in bpe.special:
            packed = struct.pack("<I", bpe.special[chunk])
        else:
            for piece in bpe.pieces(chunk):
                known = self.words.get(piece)
                if known is None:
                    ids = bpe.word(piece)
                    known = self.words[piece] = struct.pack(f"<{len(ids)}I", *ids)
                packed += known
        self[chunk] = packed
        self.decoded[chunk] = bpe.decode(struct.unpack(f"<{len(packed) // 4}I", packed)).encode()
        return packed

    def forget(self) -> None:
        """Start again once much is held, so that memory stays bounded."""
        if len(self) > self.most:
            self.clear()
            self.decoded.clear()
        if len(self.words) > self.most:
            self.words.clear()


#: By vocabulary and the number of pieces remembered.
_loaded: dict[tuple[str, int], _Remembered] = {}


def _memory(path: str, most: int = REMEMBERED) -> _Remembered:
    if (path, most) not in _loaded:
        _loaded[path, most] = _Remembered(WordBpe(path), most)
    return _loaded[path, most]


def _digests(path: str, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(path, remembered)
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            # one text at a time leaves Arrow; of each only two digests stay
            for text in batch.column("text"):
                chunks = memory.bpe.chunks(text.as_py() or "")
                packed = b"".join(map(memory.__getitem__, chunks))
                decoded = b" ".join(filter(None, map(memory.decoded.__getitem__, chunks)))
                counts.append(len(packed) // 4)
                ids_hash.append(hashlib.sha256(packed).hexdigest())
                text_hash.append(hashlib.sha256(decoded).hexdigest())
                memory.forget()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with a column token_ids (array<int>) for its text; a null text counts as empty."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        memory = _memory(path)
        return texts.map(lambda t: memory.bpe.encode(t or ""))

    return docs.withColumn("token_ids", ids("text"))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """`tokens` with a column decoded for its token_ids; a null array gives an empty text."""

    @F.pandas_udf("string")
    def texts(ids):
        memory = _memory(path)
        return ids.map(lambda x: memory.bpe.decode(list(x) if x is not None else []))

    return tokens.withColumn("decoded", texts("token_ids"))


def token_digests(docs: DataFrame, path: str, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of `docs` (doc_id, text).

    Null texts count as empty: no tokens, and the digests of nothing. Other columns are ignored and repeated
    rows each give their row. A text of any length is encoded whole, by itself. `path` names the vocabulary file, which every executor must have.
    A worker remembers the tokens of up to `remembered` distinct pieces of text: fewer take less of its memory and more time.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_digests(path, remembered), schema)
