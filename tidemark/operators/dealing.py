"""How rows are dealt over tasks where the work on them is larger than their bytes tell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group that share one copy of what they meet.
BLOCK = 256


def deal(rows: DataFrame, *by: str, share: int = 4) -> DataFrame:
    """The rows, dealt by these columns over tasks: three per core, or a shuffle's over ``share`` if that is more.

    Spark reads a small table in one task and merges small shuffles, as it goes
    by bytes; a fixed number of partitions is left alone. A task that starts
    Python costs a fraction of a second, so they aren't as many as a shuffle's.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // share, 3 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *by)


def join_blocks(left: DataFrame, right: DataFrame, keys: Sequence[str], ident: str, block: int = BLOCK) -> DataFrame:
    """An inner join whose groups are dealt in blocks of about ``block`` rows of the left side, each with a copy of the right side's rows.

    A group of any size is many tasks, and what is shuffled is the result's rows
    over ``block``. ``ident`` tells the left side's rows apart.
    """
    keys = list(keys)
    blocks = left.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("long").alias("_blocks"))
    mine = left.join(blocks, keys).withColumn("_block", F.pmod(F.xxhash64(ident), F.col("_blocks"))).drop("_blocks")
    theirs = right.join(blocks, keys).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    on = [*keys, "_block"]
    return deal(mine, *on, share=1).join(deal(theirs, *on, share=1), on).drop("_block")
