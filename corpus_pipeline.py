"""From raw documents to packed training sequences, in stages that each call one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_duplicates, packing, quality, repeats
from tidemark.llm.common import shared_folder, table
from tidemark.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null and empty texts among them, repeated rows each on their own."""
    return quality.keep(docs, marks=quality.toxic_marks(docs, table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least doc_id's; of equal ids the row with the least text key. Texts without words all stay."""
    return near_duplicates.deduplicate(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings go from the texts; a text that is all repeated stays as an empty one, a null text becomes empty."""
    cut = repeats.remove_repeats(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, every row of a text that does; null and empty texts stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, and their places in sequences; an empty text is its closing id, an empty table gives no pieces."""
    return packing.best_fit_packing(docs, tokenizer_file("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Suffix arrays and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each result is written as Parquet and read again. A stage's table goes when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    last = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{last}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        last = name
    return docs
