"""Mixing sources to target weights by iterative proportional fitting, then sampling by calibrated probability.

Tokens are counted by cell (source, language, topic). Cell weights are raked: each step scales the cells of
one category so that its weighted tokens reach the target share, until no cell moves or RAKES rounds are over, which is
told in a warning where shares still move. A document's probability is its
cell's weight, scaled so that the expected tokens meet the budget and capped at one.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.storage import discard, stored

DIMENSIONS = ("source", "lang", "topic")
#: Most rounds of raking, the relative move of every category below which it ends, and rounds in which capped cells hand
#: their excess to the others.
RAKES, STILL, CAPS = 24, 1e-10, 8
#: A share that the last round still moves by more than this part of itself is told in a warning.
SETTLED = 1e-4
#: Target shares are observed shares to this power; 1 keeps the mixture, 0 makes categories equal.
TEMPER = 0.7
#: Expected tokens of the sample as a share of all tokens.
BUDGET = 0.6
SEED = "mix-1"
#: Up to so many cells are raked in the driver's memory; more stay a distributed table and take the same steps there.
DRIVER_CELLS = 20_000

# Words, whole and in lower case, that speak for a topic in English, German, French and Spanish.
KEYWORDS = {
    "law": "law court license contract legal clause gesetz gericht vertrag lizenz recht loi tribunal contrat licence juridique ley contrato licencia juicio derecho",
    "science": "science research theory experiment study analysis forschung theorie studie versuch wissenschaft recherche experience analyse etude ciencia teoria estudio experimento",
    "commerce": "price market shop order payment customer preis markt kaufen kunde zahlung prix client commande achat paiement precio mercado cliente compra pago",
    "technology": "software server code data token computer daten rechner programm logiciel serveur donnees ordinateur datos servidor programa ordenador",
    "health": "health doctor patient disease hospital gesundheit arzt krankheit klinik sante medecin maladie hopital salud medico enfermedad",
    "society": "government election school city people regierung wahl schule stadt gouvernement ecole ville gobierno eleccion escuela ciudad",
}
#: Distinct keywords that a text must hold to be given a topic by them.
LEAST_KEYWORDS = 2
#: Shares of characters above which a text without such a topic is one of figures, or of symbols.
FIGURES, SYMBOLS = 0.02, 0.02
_SYMBOLS = "[|{}<>=;_&%$#*+]"


def topic_of(text: Column) -> Column:
    """The topic whose keywords a whole text holds most of, ties to the first in KEYWORDS; else figures, symbols or prose.

    Null and empty texts have none.
    """
    words = F.split(F.lower(text), "[^a-z]+")
    known = sorted({w for ws in KEYWORDS.values() for w in ws.split()})
    held = F.array_intersect(words, F.array(*map(F.lit, known)))
    # (keywords held, place from the end, topic): the greatest is the topic
    scored = F.transform(
        F.array(*[F.struct(F.array(*map(F.lit, ws.split())).alias("w"), F.lit(-k).alias("k"), F.lit(t).alias("t")) for k, (t, ws) in enumerate(KEYWORDS.items())]),
        lambda x: F.struct(F.size(F.array_intersect(held, x["w"])).alias("n"), x["k"].alias("k"), x["t"].alias("t")),
    )
    best = F.when(F.size(held) >= LEAST_KEYWORDS, F.array_max(scored))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / F.length(text)
    return (
        F.when(text.isNull() | (text == ""), "none")
        .when(best["n"] >= LEAST_KEYWORDS, best["t"])
        .when(share("[0-9]") > FIGURES, "figures")
        .when(share(_SYMBOLS) > SYMBOLS, "symbols")
        .otherwise("prose")
    )


def described(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens (white-space words); null categories become '?'.

    `topic` is any expression over the columns of `docs`; by default topic_of its texts.
    """
    text = F.col("text")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("source", F.lit("?")).alias("source"),
        F.coalesce("lang", F.lit("?")).alias("lang"),
        F.coalesce(topic_of(text) if topic is None else topic, F.lit("?")).alias("topic"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("n_tokens"),
    )


def _told(moved: float) -> None:
    """A warning that targets contradict each other, or that raking needs more rounds than RAKES."""
    if moved > SETTLED:
        warnings.warn(f"after {RAKES} rounds raking still moves a share by {moved:.2g} of itself", stacklevel=3)


def tempered_targets(cells: DataFrame, power: float) -> dict[str, DataFrame]:
    """For each dimension (value, share): observed token shares to `power`, scaled to one."""
    found = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("_p"))
        found[d] = sums.crossJoin(F.broadcast(sums.agg(F.sum("_p").alias("_all")))).select(d, F.try_divide("_p", "_all").alias("_share"))
    return found


def reachable(cells: DataFrame, targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """`targets` of the values that `cells` have tokens in, scaled to one again."""
    found = {}
    for d, target in targets.items():
        have = target.join(cells.where("tokens > 0").select(d).distinct(), d, "left_semi")
        found[d] = have.crossJoin(F.broadcast(have.agg(F.sum("_share").alias("_all")))).select(d, F.try_divide("_share", "_all").alias("_share"))
    return found


def given_targets(cells: DataFrame, shares: dict[str, dict[str, float]], power: float) -> dict[str, DataFrame]:
    """Targets from explicit shares by dimension and value; a dimension that is not given is tempered."""
    rows = {}
    for d, given in shares.items():
        kind = pa.schema([(d, pa.string()), ("_share", pa.float64())])
        rows[d] = cells.sparkSession.createDataFrame(pa.table([list(given), [float(x) for x in given.values()]], schema=kind))
    return reachable(cells, {d: rows.get(d, t) for d, t in tempered_targets(cells, power).items()})


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = RAKES) -> DataFrame:
    """`cells` (the dimensions, tokens) with weight: weighted token shares near the targets in every dimension.

    A category without tokens, or without a target, gets weight 0. Cells stay a distributed table.
    """
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    weighted = stored(cells.withColumn("weight", F.lit(1.0)))
    for _ in range(rounds):
        now, moves = weighted.select(*cells.columns, "weight"), []
        for d, target in targets.items():
            have = now.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("_have")).join(target, d)
            scale = have.select(d, F.when(F.col("_have") > 0, F.col("_share") * total / F.col("_have")).otherwise(0.0).alias(f"_scale_{d}"))
            now = now.join(scale, d, "left").withColumn(f"_scale_{d}", F.coalesce(f"_scale_{d}", F.lit(0.0)))
            now = now.withColumn("weight", F.col("weight") * F.col(f"_scale_{d}"))
            moves.append(F.max(F.when(F.col("weight") > 0, F.abs(F.col(f"_scale_{d}") - 1))))
        after = stored(now)
        discard(weighted)
        weighted = after
        moved = max((x or 0.0 for x in after.agg(*moves).first()), default=0.0)
        if moved < STILL:
            break
    else:
        _told(moved)
    return weighted.select(*cells.columns, "weight")


def calibrated(weighted: DataFrame, budget: float) -> DataFrame:
    """`weighted` with probability: min(1, scale * weight), the scale spending `budget` of all tokens."""
    tokens, weight = F.col("tokens").cast("double"), F.col("weight")
    total = weighted.agg(F.sum(tokens)).first()[0] or 0.0
    scale = 0.0
    for k in range(CAPS):
        capped = (weight * scale >= 1) if k else F.lit(False)
        full, open_ = weighted.agg(F.sum(F.when(capped, tokens)), F.sum(F.when(~capped, tokens * weight))).first()
        if not open_:
            break
        scale = max(scale, (budget * total - (full or 0.0)) / open_)
    return weighted.withColumn("probability", F.least(F.lit(1.0), weight * scale))


def _fitted_here(cells: pd.DataFrame, shares: dict[str, dict], budget: float) -> pd.DataFrame:
    """What rake() and calibrated() give, for a bounded table of cells."""
    tokens = cells["tokens"].to_numpy(float)
    total, weight = tokens.sum(), np.ones(len(cells))
    parts = []
    for d in DIMENSIONS:
        codes, names = pd.factorize(cells[d])
        parts.append((codes, np.array([shares[d].get(x) or 0.0 for x in names], float)))
    for _ in range(RAKES):
        moved = 0.0
        for codes, share in parts:
            have = np.bincount(codes, tokens * weight, len(share))
            scale = np.divide(share * total, have, out=np.zeros(len(share)), where=have > 0)[codes]
            weight = weight * scale
            moved = max(moved, np.abs(scale - 1)[weight > 0].max(initial=0.0))
        if moved < STILL:
            break
    else:
        _told(moved)
    scale = 0.0
    for k in range(CAPS):
        capped = (weight * scale >= 1) & (k > 0)
        open_ = (tokens * weight)[~capped].sum()
        if open_ == 0:
            break
        scale = max(scale, (budget * total - tokens[capped].sum()) / open_)
    return cells[list(DIMENSIONS)].assign(weight=weight, probability=np.minimum(1.0, weight * scale))


def probabilities(
    cells: DataFrame, targets: dict[str, dict[str, float]] | None, power: float, budget: float, driver_cells: int = DRIVER_CELLS
) -> DataFrame:
    """(source, lang, topic, weight, probability) for every row of `cells`, raked to `targets` or tempered shares."""
    wanted = given_targets(cells, targets or {}, power)
    few = cells.limit(driver_cells + 1).toPandas()
    if len(few) > driver_cells:
        found = calibrated(rake(cells, wanted), budget)
        return stored(found.select(*DIMENSIONS, "weight", "probability"))
    # only values that cells have are in a target, so what comes is no more than the cells
    shares = {d: {r[0]: r[1] for r in t.select(d, "_share").collect()} for d, t in wanted.items()}
    fitted = _fitted_here(few, shares, budget)
    kind = pa.schema([*((d, pa.string()) for d in DIMENSIONS), ("weight", pa.float64()), ("probability", pa.float64())])
    # as an Arrow table, of at most driver_cells rows: pandas rows would go through Python workers of their own on the executors
    table = pa.Table.from_pandas(fitted, schema=kind, preserve_index=False)
    return F.broadcast(cells.sparkSession.createDataFrame(table))


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that only the key and the seed decide."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def _fitted(rows: DataFrame, targets: dict | None, power: float, budget: float, driver_cells: int) -> DataFrame:
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    return probabilities(cells, targets, power, budget, driver_cells)


def mixed(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    *,
    topic: Column | None = None,
    power: float = TEMPER,
    budget: float = BUDGET,
    seed: str = SEED,
    driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, selected for every row of `docs`.

    `docs` has doc_id, text, source and lang; others are ignored unless `topic` reads them. `targets` holds the share of
    each value by dimension, scaled to the values that there are; a value left out gets none, and a dimension
    left out is tempered. Weight and probability are rounded to six places after the draw. Null source and lang count
    as '?', null and empty texts as topic none with no tokens: weight 0, never drawn. Texts of any length are read
    whole. Rows that share a doc_id are drawn by the same number, null ids never.
    """
    rows = stored(described(docs, topic))
    found = _fitted(rows, targets, power, budget, driver_cells)
    drawn = rows.join(found, [*DIMENSIONS]).withColumn("selected", uniform(F.col("doc_id"), seed) < F.col("probability"))
    return drawn.select(
        "doc_id",
        *DIMENSIONS,
        "n_tokens",
        F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"),
        F.coalesce("selected", F.lit(False)).alias("selected"),
    )


def sampled(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    *,
    topic: Column | None = None,
    power: float = TEMPER,
    budget: float = BUDGET,
    seed: str = SEED,
    driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """The rows of `docs` that the mixture draws, with their own columns; options as in mixed()."""
    found = _fitted(described(docs, topic), targets, power, budget, driver_cells)
    own = {"source": F.coalesce("source", F.lit("?")), "lang": F.coalesce("lang", F.lit("?"))}
    own["topic"] = F.coalesce(topic_of(F.col("text")) if topic is None else topic, F.lit("?"))
    named = docs.select(F.struct(*docs.columns).alias("_row"), *[own[d].alias(d) for d in DIMENSIONS])
    drawn = uniform(F.col("_row")["doc_id"].cast("bigint"), seed) < F.col("probability")
    return named.join(found, [*DIMENSIONS]).where(drawn).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def oracle(documents: str = "documents", targets: dict[str, dict[str, float]] | None = None) -> str:
    """DuckDB SQL for mixed() with its defaults and the given targets."""
    known = sorted({w for ws in KEYWORDS.values() for w in ws.split()})
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    scores = ", ".join(f"{{n: len(list_intersect(held, {listed(ws.split())})), k: {-k}, t: '{t}'}}" for k, (t, ws) in enumerate(KEYWORDS.items()))
    share = lambda pattern: f"len(regexp_extract_all(text, '{pattern}')) / length(text)"
    parts = [
        f"""held_ AS (SELECT *, list_intersect(string_split_regex(lower(text), '[^a-z]+'), {listed(known)}) AS held FROM {documents})""",
        f"""scored_ AS (SELECT *, list_max([{scores}]) AS best FROM held_)""",
        f"""rows_ AS (SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang,
  CASE WHEN text IS NULL OR text = '' THEN 'none' WHEN len(held) >= {LEAST_KEYWORDS} AND best.n >= {LEAST_KEYWORDS} THEN best.t
       WHEN {share("[0-9]")} > {FIGURES} THEN 'figures' WHEN {share(_SYMBOLS)} > {SYMBOLS} THEN 'symbols' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM scored_)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rows_ GROUP BY ALL)",
        "total AS (SELECT sum(tokens) AS t FROM cells)",
        *(
            f"""target_{d} AS MATERIALIZED (SELECT {d}, p / sum(p) OVER () AS share FROM
  (SELECT {d}, {given} AS p FROM cells GROUP BY {d}) WHERE p IS NOT NULL)"""
            for d in DIMENSIONS
            for given in [f"pow(sum(tokens), {TEMPER})" if d not in (targets or {}) else f"CASE WHEN sum(tokens) > 0 THEN CASE {d} " + " ".join(f"WHEN '{v}' THEN {x}" for v, x in targets[d].items()) + " END END"]
        ),
        "w_0 AS (SELECT *, 1.0::DOUBLE AS weight FROM cells)",
    ]
    last, k = "w_0", 0
    for _ in range(RAKES):
        for d in DIMENSIONS:
            k += 1
            parts.append(
                f"""w_{k} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN have > 0 THEN weight * coalesce(share, 0) * t / have ELSE 0 END AS weight
  FROM (SELECT *, sum(tokens * weight) OVER (PARTITION BY {d}) AS have FROM {last}) LEFT JOIN target_{d} USING ({d}), total)"""
            )
            last = f"w_{k}"
    parts.append("s_0 AS (SELECT 0.0::DOUBLE AS s)")
    for j in range(CAPS):
        capped = f"(weight * s_{j}.s >= 1)" if j else "false"
        parts.append(
            f"""s_{j + 1} AS MATERIALIZED (SELECT coalesce(greatest(any_value(s_{j}.s), ({BUDGET} * any_value(t) -
  coalesce(sum(CASE WHEN {capped} THEN tokens END), 0)) / nullif(sum(CASE WHEN NOT {capped} THEN tokens * weight END), 0)),
  any_value(s_{j}.s)) AS s FROM {last}, total, s_{j})"""
        )
    parts.append(f"done AS (SELECT source, lang, topic, weight, least(1.0, weight * s) AS probability FROM {last}, s_{CAPS})")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
  coalesce(('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 < probability, false) AS selected
FROM rows_ JOIN done USING (source, lang, topic)"""
    )
