"""Fill-in-the-middle, packing and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import documents

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [
    "<P>", "x <S> y z", "a<M", "<<P", " ", "\n\n", " a", "a ", "é 中 🙂 x", "\x00 \x85 \xa0b", "a\x1cb c", "x" * 70, "<P", "P> a", "a b <", "tail \t", "A a A a",
]


def rows():
    odd = [(1000 + 40 * k + n, t * (n + 1)) for k, t in enumerate(ODD) for n in range(12)]
    return [(r[0], r[1]) for r in documents()] + odd + [(9000, "lang " * 90_000), (9001, "中é " * 50_000 + " ")]


@pytest.fixture(scope="module")
def table(spark):
    # extra columns with names that the operators give to their own
    return spark.createDataFrame([(*r, "x", 1) for r in rows()], "doc_id bigint, text string, output string, length int").repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digits(doc_id):
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def test_bitvector():
    from pagelens.llm.fill_in_middle import BitVector

    rng = np.random.default_rng(1)
    for n, share in ((0, 0.5), (1, 1), (64, 0.5), (511, 0.01), (512, 1), (513, 0), (5000, 0.2), (5000, 0.999)):
        bits = rng.random(n) < share
        v, places = BitVector(bits), np.arange(n + 1)
        assert np.array_equal(v.rank(places), np.concatenate([[0], np.cumsum(bits)]))
        ones = np.flatnonzero(bits)
        assert np.array_equal(v.select(np.arange(1, len(ones) + 1)), ones)


def test_fill_in_middle(table, none):
    from pagelens.llm.fill_in_middle import digests, fill_in_middle

    want, outputs = Counter(), Counter()
    for doc_id, text in rows():
        text = text or ""
        units, (h1, h2, h3, h4) = TOKENS.findall(text), digits(doc_id)
        assert "".join(units) == text
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
        output = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
        chars = (None, None) if form == "plain" else (len(prefix), len(middle))
        want[doc_id, n, form, *chars, sha(output), sha(text)] += 1
        outputs[doc_id, output] += 1
    made = fill_in_middle(table)
    assert Counter((r.doc_id, r.output) for r in made.collect()) == outputs
    assert Counter(tuple(r) for r in digests(made).collect()) == want
    assert {form for _, _, form, *_ in want} == {"plain", "psm", "spm"}
    assert fill_in_middle(none).count() == 0
    # with other parameters all texts without a marker are rearranged
    assert set(r.form for r in fill_in_middle(table.where("length(text) > 3 AND NOT text RLIKE '<[PSM]>'"), rate=100, spm=0).collect()) == {"psm"}


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_byte_bpe(vocabulary):
    from tokenizers import Tokenizer

    from pagelens.llm.best_fit_packing import ByteBpe

    own, library, rng = ByteBpe(vocabulary), Tokenizer.from_file(vocabulary), random.Random(5)
    letters = "ab Z9é中　  \t\n'.,!s’\x85\x1c\xa0İß🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 16))) for _ in range(6000)]
    texts += [f"{a} <|endoftext|>{b}" for a, b in zip(texts[:500], texts[500:1000])]
    texts += [" " * 300_000 + "x", "word, " * 400_000, "a" * 300_000 + "\n" + "é!" * 400_000, "it's " * 50 + "\t" * 9000]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def best_fit_decreasing(counts, limit):
    gaps, used = Counter(), 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                used, gap = used + 1, limit
            else:
                gaps[gap] -= 1
                gaps += Counter()
            gaps[gap - length] += 1
    return used


@pytest.mark.parametrize("limit,count,low,high", [(2048, 900, 200, 1500), (2048, 900, 1, 2048), (100, 3000, 20, 45), (64, 500, 1, 9), (7, 300, 1, 7)])
def test_plan(limit, count, low, high):
    from pagelens.llm.best_fit_packing import best_plan, places

    for seed in range(3):
        rng = random.Random(seed)
        counts = Counter(rng.randint(low, high) for _ in range(count))
        found = best_plan(counts, limit)
        used = Counter()
        for times, copies in found:
            assert times > 0 and sum(x * c for x, c in copies.items()) <= limit
            used += Counter({x: times * c for x, c in copies.items()})
        assert used == counts
        number = sum(times for times, _ in found)
        assert -(-sum(x * c for x, c in counts.items()) // limit) <= number <= best_fit_decreasing(counts, limit)
        where, filled = places(found), defaultdict(list)
        for x, c in counts.items():
            sequence, offset = where.of(np.full(c, x), np.arange(c))
            for s, o in zip(sequence.tolist(), offset.tolist()):
                filled[s].append((o, x))
        assert len(filled) == number
        for parts in filled.values():
            assert [o for o, _ in sorted(parts)] == [sum(x for _, x in sorted(parts)[:k]) for k in range(len(parts))]


def test_sum_index():
    from pagelens.llm.best_fit_packing import SumIndex

    rng, limit = random.Random(2), 40
    for _ in range(20):
        index, left = SumIndex(limit), Counter()
        for _ in range(30):
            x = rng.randint(1, limit)
            left[x] = rng.choice([0, 1, 2, 3, 7])
            index.set(x, left[x])
        several = {1: Counter(), 2: Counter(), 3: Counter()}
        there = [x for x in left if left[x]]
        for a in there:
            several[1][a] += 1
            for b in (b for b in there if b >= a and left[b] >= 1 + (a == b)):
                several[2][a + b] += 1
                for c in (c for c in there if c >= b and left[c] >= 1 + (c == a) + (c == b)):
                    several[3][a + b + c] += 1
        for gap in range(1, limit + 1):
            assert [int(index.sums[k, gap]) for k in (1, 2, 3)] == [several[k][gap] for k in (1, 2, 3)]
            chosen = index.exact(gap)
            fewest = next((k for k in (1, 2, 3) if several[k][gap]), 0)
            assert len(chosen) == fewest and (not chosen or sum(chosen) == gap) and not Counter(chosen) - left


def test_pack_documents(table, none, vocabulary):
    from tokenizers import Tokenizer

    from pagelens.llm.best_fit_packing import pack_documents, sequences

    library, limit = Tokenizer.from_file(vocabulary), 300
    want, total, counts = Counter(), 0, Counter()
    for doc_id, text in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % limit + 1
        cuts = [0, *range(first, len(ids) + 1, limit)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])), tuple(ids[a:b])] += 1
            counts[b - a] += 1
        total += len(ids)
    packed = pack_documents(table, vocabulary, limit=limit, keep_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in packed) == want
    held = defaultdict(list)
    for r in packed:
        held[r.sequence_id].append((r.offset, r.length, r.ids))
    for parts in held.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert -(-total // limit) <= len(held) <= best_fit_decreasing(counts, limit)
    joined = sequences(pack_documents(table, vocabulary, limit=limit, keep_ids=True)).collect()
    assert sum(len(r.ids) for r in joined) == total and max(len(r.ids) for r in joined) <= limit
    assert Counter(i for r in joined for i in r.doc_ids) == Counter(k[0] for k in want.elements())
    assert pack_documents(none, vocabulary).count() == 0


def runs_of(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_scan(longest):
    from pagelens.llm.importance_resampling import scan

    for _, text in rows():
        words, runs = runs_of(text, longest)
        n, found = scan(text or "", longest)
        assert n == len(words) and Counter(found.tolist()) == Counter(zlib.crc32(r.encode()) for r in runs)


def test_resampled(spark, table, none):
    from pagelens.llm.importance_resampling import drawn, resampled

    targets = [(None,), ("",), ("w1 w2 w3 w4",), ("Lang LANG lang é",)]
    listed = [(i, *runs_of(t, 3)) for i, t in rows()]
    bucket = lambda run: zlib.crc32(run.encode()) % 10_000
    s, t = Counter(bucket(x) for _, _, runs in listed for x in runs), Counter(bucket(x) for (text,) in targets for x in runs_of(text, 3)[1])
    many, few = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (many + 10_000) / ((s[k] + 1) * (few + 10_000))))
    want = []
    for doc_id, words, runs in listed:
        weight = sum(gain(bucket(x)) for x in runs)
        noise = math.floor(-1000 * math.log(-math.log((digits(doc_id)[0] + 0.5) / 4294967296)))
        want.append([doc_id, len(runs), weight, weight + noise, None, len(words) >= 20])
    order = sorted((w for w in want if w[5]), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    chosen = order[: 25 * len(order) // 100]
    for k, w in enumerate(chosen):
        w[4] = k + 1
    goal = spark.createDataFrame(targets, "text string")
    got = resampled(table, goal, percent=25).collect()
    assert Counter(map(tuple, got)) == Counter(tuple(w[:5]) for w in want)
    ids = {w[0] for w in chosen} - {None}
    assert len(ids) > 3 and {r.doc_id for r in drawn(table, goal, percent=25).collect()} == ids
    assert drawn(table, goal, percent=25).columns == table.columns
    assert resampled(none, goal).count() == 0
    # without targets every bucket weighs by its own count alone
    alone = resampled(table, goal.limit(0), percent=25)
    assert alone.count() == len(want)
