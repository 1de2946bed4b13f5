"""Vectors, codes, conversations and components against brute-force versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import pagelens.llm.chat_repair as chat


def test_components(spark):
    from pagelens.llm.components import connected_components

    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    early = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint"), steps=1).collect()}
    assert early.keys() == got.keys() and all(find(x) == find(y) for x, y in early.items())


def brute_links(rows, cosine=0.95):
    """Rows (vec_id, n_links, component_id, kept) by comparing every pair of usable vectors of equal length."""
    usable = [np.array(v, float) if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else None for _, v in rows]
    unit = [None if v is None else (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for v in usable]
    link = [[] for _ in rows]
    for n in {len(v) for v in unit if v is not None}:
        at = [k for k, v in enumerate(unit) if v is not None and len(v) == n]
        x = np.array([unit[k] for k in at])
        for a, b in zip(*np.nonzero(x @ x.T >= cosine), strict=True):
            if a != b:
                link[at[a]].append(at[b])
    want = []
    for a, (i, _) in enumerate(rows):
        seen, stack = {a}, [a]
        while stack:
            for b in link[stack.pop()]:
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        least = min(rows[b][0] for b in seen)
        want.append((i, len(link[a]), least, i == least))
    return want


def test_embedding_duplicates(spark):
    from pagelens.llm.embedding_duplicates import embedding_duplicates

    random_ = np.random.default_rng(3)
    base = random_.standard_normal((150, 16))
    near = base[:40].repeat(3, 0) + random_.standard_normal((120, 16)) * 0.03
    rows = [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate(np.concatenate([base, near, base[:5]]))]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [1.0] * 8), (1005, [2.0] * 8), (3, rows[3][1]), (1006, [3.0]), (1007, [None, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "'x' AS node", "1 AS kept", "2 AS n_links")
    got, want = sorted(tuple(r) for r in embedding_duplicates(frame).collect()), brute_links(rows)
    assert sum(r[1] for r in got) / sum(r[1] for r in want) >= 0.97
    assert sum((Counter(got) & Counter(want)).values()) >= 0.95 * len(want)
    assert embedding_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("dimension", [64, 100])
def test_embedding_links_just_over_the_threshold(spark, dimension):
    """Planted pairs of cosine 0.9501 to 0.96, and none linked that is below."""
    from pagelens.llm.embedding_duplicates import embedding_duplicates, layout

    random_ = np.random.default_rng(6)
    base = random_.standard_normal((700, dimension))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = random_.standard_normal(base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = np.concatenate([random_.uniform(0.9501, 0.96, 400), random_.uniform(0.9, 0.9499, 300)])[:, None]
    vectors = np.concatenate([base, (c * base + np.sqrt(1 - c * c) * side) * 1e-30])
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    got, want = sorted(tuple(r) for r in embedding_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()), brute_links(rows)
    assert sum(r[1] for r in want) == 800
    assert sum(r[1] for r in got) >= 0.98 * 800
    assert not any(r[1] for r in got if r[0] % 700 >= 400)
    assert layout(10**9, 0.95)[0] == 28 and layout(10**9, 0.95)[1] > layout(10**4, 0.95)[1]


def test_a_large_group_of_near_vectors_is_counted_not_listed(spark):
    from pagelens.llm.embedding_duplicates import _links, embedding_duplicates

    random_ = np.random.default_rng(7)
    base = random_.standard_normal((3, 64))
    group = np.concatenate([base[0] + random_.standard_normal((400, 64)) * s for s in (0.08, 0.14)] + [base[1] + random_.standard_normal((60, 64)) * 0.05, random_.standard_normal((200, 64))])
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.concatenate([group, group[:7]]))]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got, want = sorted(tuple(r) for r in embedding_duplicates(frame).collect()), brute_links(rows)
    assert 0.98 <= sum(r[1] for r in got) / sum(r[1] for r in want) <= 1
    assert [r[2:] for r in got] == [r[2:] for r in want]
    classes = frame.selectExpr("xxhash64(embedding, 64) AS node", "embedding").distinct()
    links, balls = _links(classes, 0.95)
    assert balls.count() > 300 and links.count() < 0.8 * sum(r[1] for r in want) / 2


@pytest.mark.parametrize("share,spread", [(0.5, 0.01), (0.95, 0.01), (1.0, 0.01), (0.5, 0.03), (0.95, 0.03), (1.0, 0.03)])
def test_a_group_that_holds_most_of_the_table(spark, share, spread):
    """Recall where one group is half of the table, nearly all or all of it, within a ball (0.01) and beyond one (0.03)."""
    from pagelens.llm.embedding_duplicates import _candidates, _links, embedding_duplicates

    random_, n = np.random.default_rng(11), 1500
    base = random_.standard_normal(64)
    base /= np.linalg.norm(base)
    inside = int(share * n)
    others = random_.standard_normal((n - inside, 64))
    # pairs at the threshold among the others
    for k in range(1, len(others), 2):
        side = random_.standard_normal(64)
        side -= (side @ others[k - 1]) / (others[k - 1] @ others[k - 1]) * others[k - 1]
        side *= np.linalg.norm(others[k - 1]) / np.linalg.norm(side)
        others[k] = 0.951 * others[k - 1] + np.sqrt(1 - 0.951**2) * side
    vectors = np.concatenate([base + random_.standard_normal((inside, 64)) * spread, others])
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    want, got = linked.sum(1), {r.vec_id: r for r in embedding_duplicates(frame).collect()}
    assert all(got[k].n_links <= want[k] for k in range(n))
    assert sum(r.n_links for r in got.values()) >= 0.98 * want.sum()
    assert sum(got[k].n_links for k in range(inside, n)) >= 0.98 * want[inside:].sum()
    if spread == 0.01:
        # inside a ball nothing is listed and nothing meets
        classes = frame.selectExpr("xxhash64(embedding, 64) AS node", "embedding")
        links, balls = _links(classes, 0.95)
        assert balls.count() >= 0.99 * inside and links.count() <= n
        each = balls.selectExpr("node", "array(1, 2) AS segments", "64 AS n", "ball", "explode(array(0, 1)) AS t").selectExpr("*", "t + 1 AS value")
        assert _candidates(each, 8, 2, 0.95).count() == 0


def test_doubles_beyond_floats_are_compared(spark):
    from pagelens.llm.embedding_duplicates import embedding_duplicates

    rows = [(1, [1e200, 2e200]), (2, [1.0, 2.0]), (3, [1e-200, -2e-200]), (4, [5.0, 10.0 + 1e-12]), (5, [-0.0, 1.0]), (6, [0.0, 1.0])]
    got = sorted(tuple(r) for r in embedding_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 2, 1, False), (5, 1, 5, True), (6, 1, 5, False)]


@pytest.mark.parametrize("bits", [64, 150])
def test_hamming_top_k(spark, bits):
    from pagelens.llm.hamming_search import hamming_top_k, sign_codes

    rng = random.Random(4)
    cut = lambda x: [x >> 32 * w & 0xFFFFFFFF for w in range(-(-bits // 32))]
    codes = [(k, rng.getrandbits(bits)) for k in range(300)]
    codes += [(300 + k, codes[7][1]) for k in range(40)] + [(400 + k, codes[k][1] ^ 1 << 9 * k % bits) for k in range(60)] + [(7, codes[7][1]), (900, None), (None, 5)]
    frame = spark.createDataFrame([(i, None if c is None else cut(c)) for i, c in codes], "id bigint, code array<bigint>").selectExpr("*", "1 AS rank", "2 AS distance", "3 AS t")
    asked = frame.where("id % 50 = 7 OR id IN (0, 310)")
    got = sorted(tuple(r) for r in hamming_top_k(frame, asked, 5).collect())
    known = sorted({c for c in codes if None not in c})
    want = []
    for q, code in sorted({c for c in known if c[0] % 50 == 7 or c[0] in (0, 310)}):
        near = sorted((code ^ o).bit_count() * 10**6 + i for i, o in known if i != q)[:5]
        want += [(q, k + 1, x % 10**6, x // 10**6) for k, x in enumerate(near)]
    assert got == sorted(want)
    if bits == 64:
        assert hamming_top_k(frame.limit(3), frame.limit(1), 10).count() == 2
        assert hamming_top_k(frame.limit(0), frame.limit(0), 3).count() == 0


def test_sign_codes_take_every_component(spark):
    from pagelens.llm.hamming_search import cuts, sign_codes

    long = [1.0 if k % 3 == 0 else -1.0 for k in range(100)]
    frame = spark.createDataFrame([(1, [1.0, -1.0, 2.0]), (2, None), (3, long), (4, []), (5, [float("nan"), None, 3.0])], "vec_id bigint, embedding array<float>")
    code = sum(1 << k for k in range(0, 100, 3))
    assert {r.id: list(r.code) for r in sign_codes(frame).collect()} == {1: [5], 3: [code >> 32 * w & 0xFFFFFFFF for w in range(4)], 4: [0], 5: [4]}
    for bits, rows in ((64, 2000), (100, 10**8), (3, 5), (1000, 0)):
        parts = cuts(bits, rows)
        assert [a for a, _ in parts] == [sum(b for _, b in parts[:k]) for k in range(len(parts))] and sum(b for _, b in parts) == bits


def brute_repair(roles):
    """(cost, turns) of the best repair, by relaxing every state until nothing changes."""
    number = {"system": 1, "user": 2, "assistant": 3}

    def relabel(a, b):
        return 0 if a == b else 1 if a == 0 else 3 if 1 in (a, b) else 2

    def insertions(best):
        changed = True
        while changed:
            changed = False
            for s, (c, n) in list(best.items()):
                for t in {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}[s]:
                    if (c + 2, n + 1) < best.get(t, (10**9, 0)):
                        best[t], changed = (c + 2, n + 1), True
        return best

    best = {0: (0, 0)}
    for role in roles:
        r, now = number.get(role, 0), {}
        for s, (c, n) in best.items():
            if s:
                now[s] = min(now.get(s, (10**9, 0)), (c + 1 + relabel(r, s), n))
        for s, (c, n) in insertions(dict(best)).items():
            for t in {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}[s]:
                now[t] = min(now.get(t, (10**9, 0)), (c + relabel(r, t), n + 1))
        best = now
    return insertions(dict(best))[3]


def test_role_repair(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_ROWS", 16)
    monkeypatch.setattr(chat, "BLOCK_BYTES", 200)
    rng = random.Random(5)
    talks = {c: [rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]) for _ in range(rng.choice([1, 2, 4, 9]))] for c in range(80)}
    talks[500] = [rng.choice(["user", "assistant", "tool"]) for _ in range(400)]
    rows = [(c, t, r, rng.choice(["hi", "", None, "x" * 50])) for c, roles in talks.items() for t, r in enumerate(roles)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS conv", "2 AS at")
    got = chat.repair_roles(frame).collect()
    assert len(got) == len(rows)
    for c, roles in talks.items():
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.turn)
        text = "".join(r.rendered for r in mine)
        turns = re.findall(r"<\|im_start\|>(\w+)\n", text)
        assert re.fullmatch("(system )?(user assistant )+", " ".join(turns) + " ")
        assert text.count("<|im_end|>") == len(turns)
        assert (mine[0].conversation_cost, len(turns)) == brute_repair(roles)
        assert [r.repaired_turn for r in mine] == sorted(r.repaired_turn for r in mine)
    odd = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "a"), (1, 1, "user", "a"), (1, 1, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    assert chat.repair_roles(odd).count() == 4
    assert chat.repair_roles(odd.limit(0)).count() == 0
