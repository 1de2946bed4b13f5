"""A corpus pipeline: toxicity, near-duplicates, personal data, mixing, tokens.

Every stage takes tables like `documents`, whatever other columns they have, and an empty table gives an empty one. Null texts
count as empty, except that masking leaves them null; texts of any length are read whole, and repeated rows stay rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.storage import discard, small_batches, stored

#: Pieces of text that a worker of the last stage remembers. Workers outlive their stage, and all stages share an executor's memory.
REMEMBERED = 50_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on `labels` among `docs`, scores below one half; all others stay.

    Null and empty texts score alike, as the classifier's bias says.
    """
    from pagelens.llm.toxicity import rejected, train

    small_batches(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(~rejected(docs, model))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked from similarity 0.80: the one of least doc_id.

    Documents without words link with nothing and stay, rows of one doc_id stay or go together, and rows without
    a doc_id stay.
    """
    from pagelens.llm.near_duplicates import near_duplicates

    small_batches(spark)
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span of personal data replaced by its kind; n_chars follows the text."""
    from pagelens.llm.personal_data import masked, train

    small_batches(spark)
    changed = docs.withColumn("text", masked(docs, train(docs)))
    return changed.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the raked mixture draws; those without words or without a doc_id are never drawn."""
    from pagelens.llm.mixing import sampled

    small_batches(spark)
    return sampled(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document left; a null text counts as empty."""
    import public_tokenizers

    from pagelens.llm.bpe import token_digests

    small_batches(spark)
    return token_digests(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("tokens", tokenise),
]

#: SQL can't express the first three stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        after = stored(stage(spark, docs, sf_dir))
        discard(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
