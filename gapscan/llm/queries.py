"""The registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, common, divergence, mixing, sharding, warc
from .exact_dedup import exact_dedup
from .language import identify_language
from .multi_index import search
from .near_dedup import near_duplicate_classes
from .packing import pack_documents
from .quality import score_quality
from .spelling import spelling_variants
from .toxicity import score_toxicity


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.place(docs, ["doc_id"], fallback=["text"]).drop("text")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_warc(common.table(spark, sf_dir, "pages"), common.fresh_path(spark, "warc"))
    read = warc.read_warc(spark, archives, with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents").select("doc_id", "source"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(common.table(spark, sf_dir, "documents"), folds=3, held_fold=1)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(common.table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), folds=5, held_fold=0)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(common.table(spark, sf_dir, "documents")).drop("text_hash")


def op11_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge_quality(common.table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(common.table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(common.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_inverted_multi_index": op1_inverted_multi_index,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_sharding": op3_sharding,
    "op4_warc": op4_warc,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language_id": op7_language_id,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_toxicity": op9_toxicity,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_distribution_divergence": op11_distribution_divergence,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op5_mixing": mixing.oracle_sql(),
    "op6_exact_dedup": """
        WITH norm AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), numbered AS (
            SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   row_number() OVER (PARTITION BY t, doc_id) AS copy
            FROM norm
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, sha256(t) AS text_sha256
        FROM numbered
    """,
    "op11_distribution_divergence": divergence.oracle_sql(),
    "op12_phrase_collocations": collocations.oracle_sql(),
}
