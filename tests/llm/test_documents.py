"""Operators on documents against brute-force versions, edge rows included."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import documents


def words(text):
    return (text or "").encode().split()


def test_near_duplicates(docs, none):
    from pagelens.llm.near_duplicates import near_duplicates

    rows = [(r[0], r[1]) for r in documents()]
    sets = []
    for _, text in rows:
        w = [x.lower() for x in words(text)]
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= 85 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(i)
    want = Counter()
    for k, (i, _) in enumerate(rows):
        ids = [x for x in groups[find(k)] if x is not None] if sets[k] else ([i] if i is not None else [])
        least = min(ids) if ids else None
        want[i, len(sets[k]), least, i == least] += 1
    got = Counter(tuple(r) for r in near_duplicates(docs, percent=85).collect())
    assert got == want
    assert near_duplicates(none).count() == 0


@pytest.mark.parametrize("window", [35, 8])
def test_remove_repeats(docs, none, window):
    from pagelens.llm.substrings import remove_repeats

    rows = [(r[0], words(r[1])) for r in documents()]
    seen = Counter(tuple(w[k : k + window]) for _, w in rows for k in range(len(w) - window + 1))
    want = Counter()
    for i, w in rows:
        stay = [True] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                stay[k : k + window] = [False] * window
        kept = [x for x, s in zip(w, stay) if s]
        want[i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    assert Counter(tuple(r) for r in remove_repeats(docs, window).collect()) == want
    assert remove_repeats(none, window).count() == 0


def test_bpe_equals_the_tokenizers_library(docs, none, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pagelens.llm.bpe import WordBpe, decode, encode, token_digests

    path = public_tokenizers.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    extra = ["ΣΑΣ İx", "a<|endoftext|>B", "don't stop!!!", "é́ ﬁ 12３", "ab\x1ccd\x85e", "q" * 700, "!?" * 300]
    rows = [(r[0], r[1]) for r in documents()] + list(enumerate(extra, 900))
    want = Counter()
    for i, t in rows:
        ids = known.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        text = known.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(extra, 900)), "doc_id bigint, text string"))
    assert Counter(tuple(r) for r in token_digests(frame, path).collect()) == want
    assert token_digests(none, path).count() == 0
    turned = decode(encode(frame, path), path).select("text", "token_ids", "decoded").collect()
    assert all(list(r.token_ids) == known.encode(r.text or "", add_special_tokens=False).ids for r in turned)
    assert all(WordBpe(path).decode(list(r.token_ids)) == r.decoded for r in turned[:3])


def test_toxicity(docs, none, spark):
    from pagelens.llm.toxicity import rejected, score, train

    rows = [(i, f"plain words number {i} of calm text", 0) for i in range(300)] + [(i, f"you idiot moron {i} of calm text", 1) for i in range(300, 600)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = train(frame, labels)
    got = {r.doc_id: r for r in score(frame, model).collect()}
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == y == int(got[i].score >= 0.5)
    edge = score(docs, model).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert frame.where(rejected(frame, model)).count() == 300
    assert score(none, train(none, labels.limit(0))).count() == 0


def test_personal_data(docs, none, spark):
    from pagelens.llm.personal_data import KINDS, base_spans, find_personal_data, masked, train

    text = 'mail a.b@c.example.com, from 10.0.0.256 or 10.0.0.25; +1 (017) 555-7713 card 4000 0000 0000 0002 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + k, text) for k in range(5)], "doc_id bigint, text string"))
    detector = train(frame)
    got = find_personal_data(frame, detector).collect()
    assert len(got) == frame.count()
    for r in got:
        if r.doc_id == 500:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
            base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base_spans(text))
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            assert set(base.split(",")) <= set(r.spans.split(",")) and "secret:" in r.spans
        elif r.doc_id == 0:
            assert r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest()
    hidden = frame.where("doc_id = 500").select(masked(frame, detector).alias("t")).first().t
    assert "[EMAIL]" in hidden and "[SECRET]" in hidden and "555-7713" not in hidden
    assert find_personal_data(none, train(none)).count() == 0


def contract_spans(text):
    """Base spans by the patterns as they are written down."""
    import re

    from pagelens.llm.personal_data import luhn

    size = lambda m: sum(map(str.isdigit, m[0]))
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= size(m) <= 19 and luhn("".join(filter(str.isdigit, m[0])))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= size(m) <= 15]
    return sorted(found)


def test_base_spans_follow_the_patterns(spark):
    import random

    from pagelens.llm.personal_data import base_spans

    rng = random.Random(9)
    texts = ["".join(rng.choice("01259.@+- ()aZ%_") for _ in range(rng.randint(0, 60))) for _ in range(20_000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    for text in texts:
        assert base_spans(text) == contract_spans(text), text


def test_added_spans_gain_recall(spark):
    """Planted data that no base pattern matches: the classifier finds most of it and little else."""
    import random

    from pagelens.llm.personal_data import base_spans, find_personal_data, train

    rng = random.Random(10)
    words = lambda n: " ".join(rng.choice("the of page with number about garden river stone".split()) for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    make = {
        "secret": lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', "phone": lambda: f"call (555) {digits(3)}-{digits(4)}",
        "email": lambda: f"mail jo.{digits(2)} [at] host{digits(1)} [dot] com", "base": lambda: f"from jo{digits(2)}@host.example.com", "none": lambda: f"page {digits(3)} of {digits(4)}",
    }
    kinds = [rng.choice(list(make)) for _ in range(600)]
    rows = [(k, f"{words(8)} {make[kind]()} {words(6)}") for k, kind in enumerate(kinds)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.spans for r in find_personal_data(frame, train(frame)).collect()}
    hidden = [k for k, kind in enumerate(kinds) if kind in ("secret", "phone", "email")]
    assert not any(base_spans(rows[k][1]) for k in hidden)
    assert sum(kinds[k] + ":" in found[k] for k in hidden) >= 0.9 * len(hidden)
    assert not any(found[k] for k, kind in enumerate(kinds) if kind == "none")


def test_base_spans_are_linear_in_the_text():
    import time

    from pagelens.llm.personal_data import base_spans

    for unit in ("1", "a", "1.", "@", "0 "):
        began = time.perf_counter()
        base_spans(unit * 20_000)
        short = time.perf_counter() - began
        base_spans(unit * 200_000)
        assert time.perf_counter() - began < 1 + 60 * short


def test_toxic_features_against_direct_counts(spark):
    import numpy as np
    import pandas as pd

    from pagelens.llm.toxicity import LENGTHS, buckets, characters, log_ratios, shares

    for text in ("", "A", "You!! idiot,\n 42", "Größe ΑΒΓ ×", None, "x" * 5000):
        plain = "".join(map(chr, characters(text)))
        assert len(buckets(text)) == sum(max(0, len(plain) - n + 1) for n in LENGTHS)
        grams = Counter(plain[k : k + n] for n in LENGTHS for k in range(len(plain) - n + 1))
        ids, values = shares(text)
        assert len(ids) <= len(grams) and abs(float((values**2).sum()) - bool(grams)) < 1e-9
        # the same n-gram has the same bucket wherever it stands
        assert len({tuple(buckets(text)) for _ in range(2)}) == 1
    long = " ".join(f"word{k}" for k in range(30_000))
    x = "".join(map(chr, characters(long)))
    whole = Counter(x[k : k + n] for n in LENGTHS for k in range(len(x) - n + 1))
    assert len(buckets(long)) == whole.total() and sorted(Counter(buckets(long).tolist()).values())[-1] >= max(whole.values())
    assert plain == " " + "x" * 5000 + " " and "".join(map(chr, characters("You!! idiot,\n 42"))) == " you idiot 42 "
    sums = pd.DataFrame({"toxic": [3.0, 0.0, 1.0], "clean": [0.0, 2.0, 1.0]})
    want = [np.log(((t + 0.5) / 4) / ((c + 0.5) / 8)) for t, c in zip(sums.toxic, sums.clean)]
    assert np.allclose(log_ratios(sums, 4, 8, 0.5), want)


def test_toxicity_against_a_plain_version(spark):
    """The whole method again, on a dense table of n-grams: shares, ratios, the fit, and the scores of texts that it was not fitted on."""
    import math
    import random

    import numpy as np

    from pagelens.llm.toxicity import PRIOR, buckets, score, train

    rng = random.Random(3)
    calm, rude = [f"calm{k}" for k in range(40)], ["idiot", "moron", "you fool"]
    texts = [" ".join(rng.choice(calm) for _ in range(rng.randint(3, 9))) + (" " + rng.choice(rude) if k % 4 == 0 else "") for k in range(160)]
    labels = {k: int(k % 4 == 0) for k in range(120)}
    fitted = [k for k in labels if zlib.crc32(str(k).encode()) % 5]
    grams = {k: Counter(buckets(t).tolist()) for k, t in enumerate(texts)}
    share = {k: {b: math.sqrt(n / g.total()) for b, n in g.items()} for k, g in grams.items()}
    rows = {y: [k for k in fitted if labels[k] == y] for y in (0, 1)}
    known = sorted({b for k in fitted for b in share[k]})
    sums = {y: {b: sum(share[k].get(b, 0.0) for k in rows[y]) for b in known} for y in rows}
    average = sum(map(sum, (s.values() for s in sums.values()))) / sum(len(share[k]) for k in fitted)
    least = min(map(len, rows.values()))
    rate = lambda y, b: (sums[y][b] + PRIOR * average * len(rows[y]) / least) / len(rows[y])
    factor = np.array([10 * math.log(rate(1, b) / rate(0, b)) for b in known])
    dense = lambda k: np.array([share[k].get(b, 0.0) for b in known]) * factor
    x, y = np.array([dense(k) for k in fitted]), np.array([labels[k] for k in fitted], float)
    weight = np.array([(len(rows[int(v)]) / len(fitted)) ** -0.5 for v in y])
    weight /= weight.sum()
    beta, bias, m, v = np.zeros(len(known)), 0.0, np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for t in range(1, 101):
        error = (1 / (1 + np.exp(-(x @ beta + bias))) - y) * weight
        g = np.append(x.T @ error + 5e-4 * beta, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        beta, bias = beta - step[:-1], bias - step[-1]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    model = train(frame, spark.createDataFrame(list(labels.items()), "doc_id bigint, toxic int"))
    got = {r.doc_id: r.score for r in score(frame, model).collect()}
    for k in range(160):
        assert abs(got[k] - 1 / (1 + math.exp(-(dense(k) @ beta + bias)))) < 2e-3
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in range(160))


def test_toxicity_on_held_out_labels(spark):
    """On 97 toxic and 728 clean rows; the smaller tables hold out too few toxic ones (6 at sf0.01, 4 of them found) to tell."""
    from pagelens.llm.toxicity import score, train

    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == y] for y in (1, 0))
    assert len(toxic) > 50
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def skilling(point, bits):
    """The Hilbert index of a point by rotating it level by level (J. Skilling's transpose), for any curve of its kind."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    index = 0
    for level in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | v >> level & 1
    return index


def test_hilbert_index(spark):
    from pagelens.llm.hilbert_shards import hilbert_index

    cube = spark.range(512).selectExpr("cast(id % 8 AS int) x", "cast(id div 8 % 8 AS int) y", "cast(id div 64 AS int) z")
    path = hilbert_index(cube, ["x", "y", "z"], 3, "h").orderBy("h").collect()
    assert [r.h for r in path] == list(range(512))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(path, path[1:]))
    # every aligned run of 8**k indexes is a cube, as it is on the reference curve
    for k in (1, 2):
        for runs in (path, sorted(path, key=lambda r: skilling((r.x, r.y, r.z), 3))):
            for lo in range(0, 512, 8**k):
                assert all(len({r[c] for r in runs[lo : lo + 8**k]}) == 2**k for c in range(3))


def test_shards_against_a_plain_version(docs):
    """Bins, index, rank, shard and slot of every document again, row by row; only the curve's tables are the operator's."""
    import math

    from pagelens.llm.hilbert_shards import _curve_tables, shard_documents

    digit, after = _curve_tables(3)
    rows = [(i, (t or "").encode(), lang, source) for i, t, lang, source, *_ in documents()]
    sizes = sorted(len(t) + 8 for _, t, _, _ in rows)
    cuts = sorted({sizes[math.ceil(k / 32 * len(sizes)) - 1] for k in range(1, 32)})
    names = [sorted({r[c] for r in rows if r[c] is not None}) for c in (3, 2)]

    def index(point):
        h = state = 0
        for level in reversed(range(5)):
            cell = state * 8 + sum((c >> level & 1) << k for k, c in enumerate(point))
            h, state = h * 8 + digit[cell], after[cell]
        return h

    order = []
    for i, text, lang, source in rows:
        size = len(text) + 8
        bins = [0 if v is None else known.index(v) for v, known in zip((source, lang), names)]
        order.append((index([*bins, sum(size > c for c in cuts)]), size, zlib.crc32(text), i is not None, i or 0, i))
    want, n = Counter(), len(rows)
    for rank, (_, size, crc, _, _, i) in enumerate(sorted(order, key=lambda x: x[:5])):
        shard = rank * 24 // n
        want[i, size, crc, shard, rank - math.ceil(shard * n / 24)] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in shard_documents(docs).collect()) == want


def test_string_dimensions_are_cut_by_whole_values(spark):
    from pagelens.llm.hilbert_shards import hilbert_shards, quantised, string_cuts, write_shards

    names = ["crawl-2019", "crawl-2020", "crawl-2021-b", "crawl-2", None]
    frame = spark.range(500).selectExpr("id", f"element_at(array({', '.join('NULL' if n is None else repr(n) for n in names)}), cast(id % 5 + 1 AS int)) AS name", "'x' AS shard")
    bins = {r.name: r.b for r in frame.select("name", quantised(frame, ["name"], 3)["name"].alias("b")).distinct().collect()}
    assert bins == {None: 0, "crawl-2": 0, "crawl-2019": 1, "crawl-2020": 2, "crawl-2021-b": 3}
    many = spark.range(3000).selectExpr("concat('https://host/', lpad(cast(pow(id, 2) % 3001 AS string), 5, '0')) AS name")
    values = sorted(r.name for r in many.collect())
    cuts = string_cuts(many, "name", 3)
    assert len(cuts) == 7 and cuts == sorted(cuts)
    counts = Counter(sum(v >= c for c in cuts) for v in values)
    assert all(abs(n - 375) <= 5 for n in counts.values())
    placed = hilbert_shards(frame, ["name", "id"], ["id"], 4)
    assert placed.columns == ["id", "name", "shard", "slot"] and sorted(r["count"] for r in placed.groupBy("shard").count().collect()) == [125] * 4


def test_written_shards_are_in_order(spark, tmp_path):
    from pagelens.llm.hilbert_shards import hilbert_shards, write_shards

    placed = hilbert_shards(spark.range(900).selectExpr("id", "id % 30 AS a", "id div 30 AS b"), ["a", "b"], ["id"], 5)
    write_shards(placed, str(tmp_path / "out"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "a", "b", "shard", "slot").collect()} == {tuple(r) for r in placed.collect()}
    import glob

    for f in glob.glob(str(tmp_path / "out" / "shard=*" / "*.parquet")):
        slots = [r.slot for r in spark.read.parquet(f).collect()]
        assert slots == sorted(slots)


def test_hilbert_shards(docs, none, spark):
    from pagelens.llm.hilbert_shards import shard_documents

    got = shard_documents(docs, 7).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in documents())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert shard_documents(none, 7).count() == 0


def test_topics(spark):
    from pagelens.llm.mixing import topic_of

    texts = {"The court read the contract, again the court.": "law", "Der Arzt in der Klinik": "health", "court doctor hospital": "health", "12 34 of 5": "figures", "a | b | c": "symbols", "just words court": "prose", "": "none"}
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    assert {r.text: r.t for r in frame.select("text", topic_of(F.col("text")).alias("t")).collect()} == texts | {None: "none"}


def brute_rake(cells, shares, rounds=200):
    weight = dict.fromkeys(cells, 1.0)
    total = sum(cells.values())
    for _ in range(rounds):
        for d in range(3):
            have = Counter()
            for c, w in weight.items():
                have[c[d]] += cells[c] * w
            weight = {c: w * shares[d].get(c[d], 0) * total / have[c[d]] if have[c[d]] else 0 for c, w in weight.items()}
    return weight


def test_mixing(docs, none):
    from pagelens.llm.mixing import mixed, sampled

    got = mixed(docs).collect()
    assert len(got) == docs.count()
    assert all(r.weight == 0 and not r.selected for r in got if r.n_tokens == 0 and r.topic == "none")
    tokens = sum(r.n_tokens for r in got)
    expected = sum(r.n_tokens * r.probability for r in got)
    assert abs(expected / tokens - 0.6) < 0.01
    by_source = defaultdict(lambda: [0.0, 0.0])
    for r in got:
        by_source[r.source][0] += r.n_tokens
        by_source[r.source][1] += r.n_tokens * r.weight
    target = {s: v[0] ** 0.7 for s, v in by_source.items()}
    for s, (_, weighted) in by_source.items():
        assert abs(weighted / tokens - target[s] / sum(target.values())) < 0.001
    assert sampled(docs).count() == sum(r.selected for r in got)
    assert sampled(docs).columns == docs.columns
    near = lambda rows: sorted(repr((r.doc_id, r.source, r.n_tokens, round(r.weight, 4), round(r.probability, 4))) for r in rows)
    assert near(mixed(docs, driver_cells=0).collect()) == near(got)
    assert mixed(none).count() == 0 and sampled(none).count() == 0
    assert all(not r.selected for r in mixed(docs.where("trim(text) = ''")).collect())


def test_raking_tells_when_targets_contradict(spark):
    import warnings

    from pagelens.llm.mixing import mixed

    rows = [(k, "word " * 10, lang, source) for k, (lang, source) in enumerate([("en", "a"), ("de", "b")] * 20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    options = {"topic": F.lit("t")}
    for cells in (0, 20):
        with pytest.warns(UserWarning, match="still moves"):
            mixed(frame, {"lang": {"en": 0.9, "de": 0.1}, "source": {"a": 0.5, "b": 0.5}}, driver_cells=cells, **options)
        with warnings.catch_warnings():
            warnings.simplefilter("error", UserWarning)
            mixed(frame, {"lang": {"en": 0.9, "de": 0.1}, "source": {"a": 0.9, "b": 0.1}}, driver_cells=cells, **options)


def test_shards_keep_columns_of_any_name(spark):
    from pagelens.llm.hilbert_shards import hilbert_shards

    rows = [(k, f"s{k % 3}", k * 7 % 11, -1, f"_{k}", k) for k in range(50)]
    frame = spark.createDataFrame(rows, "id bigint, source string, size bigint, shard int, _row string, _d0 bigint")
    found = hilbert_shards(frame, ["source", "size"], ["_d0"], 4)
    assert found.columns == ["id", "source", "size", "_row", "_d0", "shard", "slot"]
    got = found.collect()
    assert sorted((r.id, r.source, r.size, r["_row"], r["_d0"]) for r in got) == [(r[0], r[1], r[2], r[4], r[5]) for r in rows]
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {sum(r.shard == s for r in got) for s in range(4)} == {12, 13}


def test_mixing_to_given_targets(docs):
    from pagelens.llm.mixing import mixed, sampled

    targets = {"source": {"s0": 3.0, "s1": 1.0, "?": 1.0, "absent": 5.0}, "lang": {"en": 0.5, "de": 0.3, "?": 0.2}, "topic": {"a": 0.25, "b": 0.75}}
    clash = docs.withColumn("topic", F.lit("x")).withColumn("weight", F.lit(1)).withColumn("probability", F.lit(0))
    options = {"topic": F.when(F.length("text") % 2 == 0, "a").otherwise("b"), "budget": 0.3}
    got = mixed(clash, targets, **options).collect()
    cells = Counter()
    for r in got:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    shares = [{"s0": 0.6, "s1": 0.2, "?": 0.2}, targets["lang"], targets["topic"]]
    want = brute_rake(cells, shares)
    assert all(abs(r.weight - want[r.source, r.lang, r.topic]) < 1e-3 * max(1, r.weight) for r in got)
    drawn = sampled(clash, targets, **options)
    assert drawn.columns == clash.columns and drawn.count() == sum(r.selected for r in got)


def test_pipeline_stages_keep_the_columns(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    from pagelens.llm.near_duplicates import near_duplicates
    from pagelens.llm.storage import stored

    stage = dict(corpus_pipeline.STAGES)
    one = stored(stage["toxicity"](spark, docs, folder))
    two = stored(stage["near_duplicates"](spark, one, folder))
    three = stored(stage["personal_data"](spark, two, folder))
    four = stored(stage["mixing"](spark, three, folder))
    for step in (one, two, three, four):
        assert step.columns == docs.columns
    assert ids(two) == {r.doc_id for r in near_duplicates(one).where("kept").collect()}
    assert ids(three) == ids(two) and three.where("text RLIKE '@[a-z0-9]+[.]example'").count() == 0
    assert ids(four) < ids(three) < ids(docs)
    assert stage["tokens"](spark, four, folder).count() == len(ids(four))


def test_pipeline_near_duplicates_link_from_080(docs, spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    folder = "/root/testdata/sf0.001"
    for frame in (docs, spark.read.parquet(f"{folder}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect() if r.doc_id is not None]
        sets = []
        for _, text in rows:
            w = [x.lower() for x in words(text)]
            sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
        group = list(range(len(rows)))
        for a in range(len(rows)):
            for b in range(a):
                same = len(sets[a] & sets[b])
                if same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                    old, new = group[a], group[b]
                    group = [new if g == old else g for g in group]
        want = {min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group)}
        left = stage(spark, frame.where("doc_id IS NOT NULL"), folder)
        assert left.columns == frame.columns
        assert {r.doc_id for r in left.select("doc_id").collect()} == want


def brute_components(rows, percent):
    """The rows (doc_id, text) that are the least of their group of near-duplicates."""
    sets = []
    for _, text in rows:
        w = [x.lower() for x in words(text)]
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(i, least.get(g, i))
    return [r for r, g in zip(rows, group) if r[0] == least[g]]


def test_pipeline_against_plain_python(spark, tmp_path):
    """run() over all documents, edge rows among them, against the same stages in plain Python."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers
    from tokenizers import Tokenizer

    from pagelens.llm import mixing, personal_data, toxicity

    folder = "/root/testdata/sf0.001"
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*columns).collect()]
    rows += [(90_000 + k, t, None if k % 2 else "en", None if k % 3 else "src1", 0) for k, t in enumerate([None, "", " \t", "one", "one", "ONE", "w " * 700_000, "call (555) 123-4567 [at]", "you idiot stupid moron loser"])]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    model = toxicity.train(spark.read.parquet(str(tmp_path / "documents.parquet")), labels)
    clean = [r for r in rows if model.score(r[1]) < 0.5]
    kept = {i for i, _ in brute_components([(r[0], r[1]) for r in clean], 80)}
    left = [r for r in clean if r[0] in kept]
    detector = personal_data.train(spark.createDataFrame([(r[1],) for r in left], "text string"))
    left = [(r[0], None if r[1] is None else personal_data.mask(r[1], personal_data.all_spans(r[1], detector, {})[1]), r[2], r[3]) for r in left]
    topic = {r.doc_id: r.topic for r in mixing.described(spark.createDataFrame(left, "doc_id bigint, text string, lang string, source string")).collect()}
    cell = {r[0]: (r[3] or "?", r[2] or "?", topic[r[0]]) for r in left}
    tokens = Counter()
    for r in left:
        tokens[cell[r[0]]] += len(words(r[1]))
    shares = []
    for d in range(3):
        have = Counter()
        for c, n in tokens.items():
            have[c[d]] += n
        powers = {v: n**mixing.TEMPER for v, n in have.items()}
        shares.append({v: p / sum(powers.values()) for v, p in powers.items()})
    weight, total = brute_rake(tokens, shares), sum(tokens.values())
    # the scale that spends the budget with probabilities capped at one
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(n * min(1, weight[c] * middle) for c, n in tokens.items()) < mixing.BUDGET * total else (low, middle)
    known, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, text, _, _ in left:
        draw = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        if draw < weight[cell[i]] * low:
            ids = known.encode(text or "", add_special_tokens=False).ids
            plain = known.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()))
    assert got == sorted(want) and len(got) > 50


def test_stages_take_edge_tables(docs, none, spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs, none, docs.where("text IS NULL")):
            out = stage(spark, frame, folder)
            if name != "tokens":
                assert out.columns == frame.columns
            assert out.count() <= frame.count()
        if name in ("personal_data", "tokens"):
            assert stage(spark, docs, folder).count() == docs.count()


@pytest.mark.parametrize("size", [40_000, 400_000])
def test_long_texts_and_rows_without_ids(spark, size):
    """Texts over a slice, near-duplicates and repeats through a row without a doc_id."""
    from pagelens.llm.near_duplicates import near_duplicates
    from pagelens.llm.substrings import remove_repeats

    rng = random_words(size)
    one, two, three = list(rng), list(rng), list(rng)
    for k in range(size // 200):
        two[(k * 193) % size] = f"two{k}"
        three[(k * 193) % size], three[(k * 389 + 7) % size] = f"two{k}", f"three{k}"
    rows = [(1, " ".join(one)), (None, " ".join(two)), (2, " ".join(three)), (3, "other " * 10)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(frame, percent=85).collect()}
    assert got == {1: 1, None: 1, 2: 1, 3: 3}
    removed = {r.doc_id: r.n_removed for r in remove_repeats(frame).collect()}
    assert removed[1] > size // 2 and removed[3] == 0


def random_words(size):
    import random

    rng = random.Random(8)
    return [f"w{rng.randrange(50_000)}" for _ in range(size)]


def test_cells_reach_executors_without_python_workers(spark):
    from pagelens.llm.mixing import given_targets, probabilities

    values = ", ".join(f"('s{k % 3}', '{lang}', 'prose', {10 + k})" for k, lang in enumerate(["en", "de", "en", "?", "de"]))
    cells = spark.sql(f"SELECT * FROM VALUES {values} AS t(source, lang, topic, tokens)")
    found, targets = probabilities(cells, None, 0.7, 0.6), given_targets(cells, {"lang": {"en": 1.0, "de": 0.5}}, 0.7)
    for df in (found, targets["lang"]):
        assert "ExistingRDD" not in df._jdf.queryExecution().toString()
    assert {r[0]: round(r[1], 6) for r in targets["lang"].collect()} == {"en": round(2 / 3, 6), "de": round(1 / 3, 6)}
    assert found.columns == ["source", "lang", "topic", "weight", "probability"] and found.count() == 5


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    import corpus_pipeline
    from pagelens.llm import bpe, near_duplicates
    from pagelens.llm import words as w

    tables = [w._Powers(w._BYTE_BASE), w._Powers(w._WORD_BASE)]
    monkeypatch.setattr(w, "_bytes_powers", tables[0])
    monkeypatch.setattr(w, "_word_powers", tables[1])
    texts = [" ".join(f"w{k * j % 977}" for k in range(200)) for j in range(1, 2000)] + [None, "", "a b " * 600_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "row", "text"])
    assert sum(x.num_rows for x in near_duplicates._features(5, 8)(iter([batch]))) == len(texts)
    # a long text's powers go with it
    assert sum(x.nbytes for t in tables for x in (t.up, t.down)) <= 10 << 20

    path = public_tokenizers.path("word_bpe_49k.json")
    many = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array([" ".join(f"{chr(97 + k % 26)}x{j * 400 + k}q" for k in range(400)) for j in range(300)])], names=["doc_id", "text"])
    few, usual = (b"".join(str(x.to_pydict()).encode() for x in bpe._digests(path, n)(iter([many]))) for n in (corpus_pipeline.REMEMBERED, bpe.REMEMBERED))
    assert few == usual
    held = bpe._loaded.pop((path, corpus_pipeline.REMEMBERED))
    assert corpus_pipeline.REMEMBERED <= 50_000 and max(len(held), len(held.decoded), len(held.words)) <= corpus_pipeline.REMEMBERED
