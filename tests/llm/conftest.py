import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score string, shard string"


def documents(seed=1):
    """Edge rows first: null, empty, blank, null columns, repeated rows, a long text; then copies and near copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = [say(60).split() for _ in range(3)], say(45)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "one two"), (4, "one two"), (5, "ONE Two"), (6, say(4000)), (7, None)]
    rows += [(10 + k, " ".join(base[k % 3])) for k in range(6)]
    for k in range(20):
        near = list(base[k % 3])
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = rng.choice(words)
        rows.append((20 + k, " ".join(near)))
    rows += [(50 + k, f"{say(20)}\n{passage} {say(15)}") for k in range(8)]
    rows += [(80, "x " * 200), (None, say(50)), (None, say(40))]
    langs = ["en", "de", None]
    return [(i, t, langs[n % 3], None if n % 7 == 0 else f"s{n % 2}", len(t) if t else None, "k", "s", "h") for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
