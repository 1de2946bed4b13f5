"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans follow fixed patterns and always stay. Broader patterns propose further candidates; regex,
gazetteer, checksum, shape and context labelers vote for, against or not at all on every candidate of the
corpus. Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability
without labels; its posteriors train a logistic span classifier, which decides on the further candidates.
Only the counts of patterns reach the driver: at most kinds * 3**5 votes * 2**6 features of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of ties; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
VOTERS = ("regex", "gazetteer", "checksum", "shape", "context")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MASKED_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_HEX = re.compile(r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])[0-9a-f]{24,128}(?![0-9A-Za-z])")

# Words that tend to stand before or name each kind, and beginnings that issuers use.
_CUES = {
    "email": ("mail", "contact", "write", "e-mail", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "from", "login"),
    "card": ("card", "visa", "credit", "pay", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "telefon", "appel"),
    "secret": ("token", "key", "secret", "password", "passwd", "bearer", "api"),
}
_AGAINST = ("version", "license", "isbn", "page", "chapter", "sha", "md5", "commit", "figure")
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "2")
_ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them from left to right, in time linear in the text."""
    at, least = text.find("@"), 0
    while at >= 0:
        start = at
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        least = found.end() if found else at + 1
        at = text.find("@", least)


def _dotted(text: str) -> Iterator[tuple[int, int, bool]]:
    """Runs of four dotted numbers, and whether each is at most 255."""
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        if len(parts) < 4:
            continue
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            yield at, end, all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four)
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in that order."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(a, 1, b) for a, b, ok in _dotted(text) if ok]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found)


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further spans that may be personal data, none touching a base span or one another."""
    found: list[tuple[int, int, int]] = []
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        found += [(m.start(), 0, m.end()) for m in _MASKED_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [(a, 1, b) for a, b, ok in _dotted(text) if not ok]
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 13 <= sum(map(str.isdigit, m[0])) <= 19]
        found += [(m.start(), 3, m.end()) for m in _LOCAL_PHONE.finditer(text)]
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text)]
        found += [(m.start(), 4, m.end()) for m in _HEX.finditer(text)]
    taken, kept, k, end = sorted((a, b) for a, _, b in base), [], 0, 0
    for a, kind, b in sorted(found, key=lambda s: (s[0], -s[2], s[1])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= end and not (k < len(taken) and taken[k][0] < b):
            kept.append((a, kind, b))
            end = b
    return kept


def votes_and_features(text: str, span: tuple[int, int, int], is_base: bool) -> tuple[int, int]:
    """The voters' votes (0 against, 1 silent, 2 for) as base-3 digits, and six binary features as bits."""
    a, kind, b = span
    body, name = text[a:b], KINDS[kind]
    before, after = text[max(0, a - 24) : a].lower(), text[b : b + 12].lower()
    digits = "".join(filter(str.isdigit, body))
    cue = any(c in before for c in _CUES[name])
    against = any(c in before for c in _AGAINST)
    glued = bool(before and before[-1].isalnum()) or bool(after and after[0].isalnum())
    regex_vote = 2 if is_base else 1
    if name == "email":
        gazetteer = 2 if body.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].lower() in _ENDINGS else 1
        checksum, shape = 1, 2 if len(body) <= 96 and not body.startswith(".") else 0
    elif name == "ip":
        parts = re.findall("[0-9]+", body)
        valid = all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
        gazetteer, checksum, shape = 1, 2 if valid else 0, 2 if all(len(p) <= 3 for p in parts) else 0
    elif name == "card":
        gazetteer = 2 if digits.startswith(_ISSUERS) else 0
        checksum, shape = 2 if luhn(digits) else 0, 2 if len(digits) in (15, 16) else 1
    elif name == "phone":
        gazetteer = 2 if body.startswith("+") or "555" in digits else 1
        checksum, shape = 2 if 10 <= len(digits) <= 15 else 0, 2 if "(" in body or "-" in body else 1
    else:
        gazetteer = 2 if any(c in before for c in _CUES["secret"]) else 1
        checksum, shape = 1, 2 if len(body) in (32, 40, 64) and len(set(body)) >= 8 else 0
    context = 2 if cue else 0 if against else 1
    packed = 0
    for v in (regex_vote, gazetteer, checksum, shape, context):
        packed = packed * 3 + v
    quoted = before[-1:] in "\"'=<" and bool(before)
    bits = (cue, against, glued, quoted, len(body) > 16, after[:1] in ("", " ", ".", ",", "\n", '"', ")", ";"))
    return packed, sum(1 << i for i, x in enumerate(bits) if x)


def _patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[tuple[int, int, int], int] = {}
        for text in batch["text"]:
            base = base_spans(text)
            for is_base, spans in ((True, base), (False, candidate_spans(text, base))):
                for span in spans:
                    key = (span[1], *votes_and_features(text, span, is_base))
                    counts[key] = counts.get(key, 0) + 1
        rows = [(*key, n) for key, n in counts.items()]
        yield pd.DataFrame(rows, columns=["kind", "votes", "features", "n"])


def _features_matrix(kind: np.ndarray, votes: np.ndarray, features: np.ndarray) -> np.ndarray:
    digits = np.stack([votes // 3 ** (len(VOTERS) - 1 - j) % 3 for j in range(1, len(VOTERS))], 1)
    return np.concatenate(
        [
            np.eye(len(KINDS))[kind],
            (digits == 2).astype(float),
            (digits == 0).astype(float),
            (features[:, None] >> np.arange(6)) & 1,
            np.ones((len(kind), 1)),
        ],
        1,
    )


@dataclass(frozen=True)
class Detector:
    """Reliabilities of the voters (P(vote | absent, present)) and the classifier's weights."""

    reliability: np.ndarray
    weights: np.ndarray

    def accepts(self, kind: int, votes: int, features: int) -> bool:
        x = _features_matrix(np.array([kind]), np.array([votes]), np.array([features]))[0]
        return bool(x @ self.weights > 0)


def fit(counts: pd.DataFrame, rounds: int = 50) -> Detector:
    """EM over counted vote patterns, then a logistic regression on the posteriors; empty counts accept nothing."""
    if not len(counts):
        return Detector(np.full((len(VOTERS), 2, 3), 1 / 3), _features_matrix(*np.zeros((3, 1), int))[0] * 0)
    kind, votes, features, n = (counts[c].to_numpy(np.int64) for c in ("kind", "votes", "features", "n"))
    digits = np.stack([votes // 3 ** (len(VOTERS) - 1 - j) % 3 for j in range(len(VOTERS))], 1)
    balance = (digits == 2).sum(1) - (digits == 0).sum(1)
    posterior = 1 / (1 + np.exp(-1.5 * (balance - 1.0)))
    reliability = np.zeros((len(VOTERS), 2, 3))
    for _ in range(rounds):
        prior = np.array([((posterior * n)[kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        log_odds = np.log(prior / (1 - prior))[kind]
        for j in range(len(VOTERS)):
            for y, share in ((0, 1 - posterior), (1, posterior)):
                got = np.bincount(digits[:, j], share * n, 3) + 1.0
                reliability[j, y] = got / got.sum()
            log_odds += np.log(reliability[j, 1] / reliability[j, 0])[digits[:, j]]
        posterior = 1 / (1 + np.exp(-np.clip(log_odds, -40, 40)))
    x, weights = _features_matrix(kind, votes, features), None
    weights, share = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(30):  # Newton steps on the ridge-regularised logistic loss
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -40, 40)))
        gradient = x.T @ (share * (p - posterior)) + 1e-4 * weights
        hessian = (x * (share * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-4 * np.eye(len(weights))
        weights = weights - np.linalg.solve(hessian, gradient)
    return Detector(reliability, weights)


def train(docs: DataFrame) -> Detector:
    """Fit on the votes of every candidate span in `docs`."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    each = texts.mapInPandas(_patterns, "kind int, votes int, features int, n bigint")
    return fit(each.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).toPandas())


def all_spans(text: str, detector: Detector, memory: dict[tuple[int, int, int], bool]) -> tuple[list, list]:
    base = base_spans(text)
    more = []
    for span in candidate_spans(text, base):
        key = (span[1], *votes_and_features(text, span, False))
        if key not in memory:
            memory[key] = detector.accepts(*key)
        if memory[key]:
            more.append(span)
    return base, sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def find_personal_data(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of `docs` (doc_id, text).

    Counts and digest are of base spans, `spans` lists all; positions are code points. A null text counts as
    empty: no spans, and the digest of nothing. Repeated rows each give a row; other columns are ignored. A text of any
    length is read whole, by itself. Ties at one start go by kind, then by end.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[tuple[int, int, int], bool] = {}
        for batch in batches:
            counts, digests, listed = [[], [], [], []], [], []
            for text in batch.column("text"):
                base, every = all_spans(text.as_py() or "", shared.value, memory)
                kinds = [kind for _, kind, _ in base]
                for k in range(4):
                    counts[k].append(kinds.count(k))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                listed.append(_joined(every))
            columns = [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(listed, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """`text` with each span, or each run of overlapping spans, replaced by its kind in brackets."""
    parts, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def masked(docs: DataFrame, detector: Detector) -> Column:
    """An expression for `text` with all personal data masked; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        memory: dict[tuple[int, int, int], bool] = {}
        return texts.map(lambda t: t if t is None else mask(t, all_spans(t, shared.value, memory)[1]))

    return replace("text")
