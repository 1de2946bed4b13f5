"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Token shares that op1_mixing rakes languages and topics to; those of sources are tempered.
TARGETS = {
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15},
    "topic": {"prose": 0.5, "symbols": 0.1, "figures": 0.1, "law": 0.06, "science": 0.06, "commerce": 0.06, "technology": 0.06, "health": 0.03, "society": 0.03},
}

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.mixing import mixed

    return mixed(read(spark, sf_dir, "documents"), TARGETS)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.near_duplicates import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op3_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.substrings import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"), window=35)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.storage import small_batches
    from pagelens.llm.toxicity import score, train

    small_batches(spark)
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


def op5_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.embedding_duplicates import embedding_duplicates

    return embedding_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.95)


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.hilbert_shards import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"), shards=24)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pagelens.llm.bpe import token_digests

    return token_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.personal_data import find_personal_data, train

    docs = read(spark, sf_dir, "documents")
    return find_personal_data(docs, train(docs))


def op9_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.chat_repair import repair_roles

    return repair_roles(read(spark, sf_dir, "conversations"))


def op10_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.hamming_search import hamming_top_k, sign_codes

    codes = sign_codes(read(spark, sf_dir, "embeddings"))
    return hamming_top_k(codes, codes.where("id % 100 = 0"), k=10)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.fill_in_middle import digests, fill_in_middle

    return digests(fill_in_middle(read(spark, sf_dir, "documents"), rate=50, spm=80, seed=42))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pagelens.llm.best_fit_packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=2048, end=0)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelens.llm.importance_resampling import resampled

    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=5, least_words=20)


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_remove_repeats": op3_remove_repeats,
        "op4_toxicity": op4_toxicity,
        "op5_embedding_duplicates": op5_embedding_duplicates,
        "op6_hilbert_shards": op6_hilbert_shards,
        "op7_bpe": op7_bpe,
        "op8_personal_data": op8_personal_data,
        "op9_chat_repair": op9_chat_repair,
        "op10_hamming_top_k": op10_hamming_top_k,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_best_fit_packing": op12_best_fit_packing,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    from pagelens.llm import fill_in_middle, hamming_search, mixing

    return {
        "op1_mixing": mixing.oracle(targets=TARGETS),
        "op10_hamming_top_k": hamming_search.oracle(k=10),
        "op11_fill_in_middle": fill_in_middle.ORACLE,
    }
