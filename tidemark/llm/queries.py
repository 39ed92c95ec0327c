"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.apply_policy(quality.ledger(docs, marks=quality.toxic_marks(docs, table(spark, sf_dir, "labels"))))
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.mask("base"))) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits"
    )


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_duplicates

    return near_duplicates.jaccard_join(table(spark, sf_dir, "documents")).drop("k1", "k2", "class_key")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats

    cut = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm_scoring

    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_extract

    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")).drop("ids")


def op8_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    rows = sharding.vector_shards(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' totals after a life of batches: arrival, sorting, a mistaken load, its deletion, and every batch sent again.

    Documents arrive without a source and are counted in words only; a revision
    files them under their sources and adds the vocabulary's counts.
    """
    from . import token_counts as tc
    from .common import durable

    counts = durable(tc.count_tokens(table(spark, sf_dir, "documents"), {"words-1": tc.words, "word_bpe_49k-1": tc.vocabulary(tokenizer_file("word_bpe_49k.json"))}))
    arrived = counts.filter("tokenizer = 'words-1'").withColumn("source", F.lit(None).cast("string"))
    rollup = tc.Rollup(spark, shared_folder(spark, "rollup"))
    life = {"arrival": tc.signed(arrived, 1), "sorting": tc.changes(arrived, counts), "mistake": tc.signed(counts, 1), "deletion": tc.signed(counts, -1)}
    for _ in range(2):
        for batch, deltas in life.items():
            rollup.commit(batch, deltas)
    rollup.compact()
    return rollup.totals()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op1_jaccard_join": op1_jaccard_join,
    "op2_decontamination": op2_decontamination,
    "op6_html_extraction": op6_html_extraction,
    "op5_language_id": op5_language_id,
    "op4_lm_scoring": op4_lm_scoring,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_vector_sharding": op8_vector_sharding,
    "op10_token_rollup": op10_token_rollup,
    "op9_quality_rules": op9_quality_rules,
}

ORACLE_SQL: dict[str, str] = {}
