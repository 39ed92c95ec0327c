"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of characters other than these.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one, but only if driver and executors are one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/tidemark-{os.getpid()}"


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder that spark.checkpoint.dir names."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_shared(spark))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the driver drop what nothing refers to any more, so that Spark removes the shuffle files behind it before more are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def with_text_key(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds k1 and k2, two independent 64-bit hashes of the text (null: empty): equal texts share them."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"k1": F.xxhash64(t), "k2": F.xxhash64(F.lit("second"), t, F.length(t))})


def let(value, body):
    """body(value) with value evaluated once per row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int, per_bucket: int = 200_000) -> DataFrame:
    """Adds ``name``: 0, 1, ... within each key, without gathering a key's rows in one task.

    The rows of a key are dealt over buckets by a hash of ``order``, counted
    per bucket, and ranked inside their bucket. ``rows``: how many df has.
    """
    buckets = max(16, -(-rows // per_bucket))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select(*keys, "_bucket", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    own = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        dealt.withColumn("_own", F.row_number().over(own) - 1)
        .join(before, [*keys, "_bucket"])
        .withColumn(name, (F.col("_own") + F.col("_before")).cast("long"))
        .drop("_bucket", "_own", "_before")
    )
