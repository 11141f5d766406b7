"""Global order without a global sort in one task, and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent on one machine (tests) is a folder of our own set: on a cluster the executors would
    not see it, so its absence there is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleaner-checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder, and read again.

    Unlike a checkpoint it doesn't keep the planner's estimate of its size, which a chain of self-joins squares at each
    step until planning itself is what takes long. The caller of a job clears the folder after it.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row_number(df: DataFrame, keys: list[str | Column], name: str = "row_no", weight: str | None = None, total: str = "row_sum") -> DataFrame:
    """Add the 0-based global position in the order of ``keys`` without sorting in one task.

    A key is a column's name (nulls first) or an order such as ``F.desc("score")``.
    The rows are range-partitioned and sorted, the sorted rows are checkpointed (so both passes see the same order), and
    each partition's first number is the running total of the partitions' counts: one small row a partition.
    Rows equal in every key may take their numbers in either order. With ``weight`` the column ``total`` holds the sum
    of the weights of all earlier rows as well.
    """
    spark = df.sparkSession
    tie, part, mono = "__tie", "__part", "__mono"
    ranged = df.withColumn(tie, F.monotonically_increasing_id())
    order = [F.col(k).asc_nulls_first() if isinstance(k, str) else k for k in keys] + [F.col(tie)]
    ranged = ranged.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).drop(tie)
    placed = checkpointed(ranged.withColumn(mono, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(mono, 33)).withColumn(mono, F.col(mono).bitwiseAND(F.lit((1 << 33) - 1)))
    sums = placed.groupBy(part).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(weight) if weight else F.lit(0)).alias("__w"))
    # One row a partition of the cluster's shuffle: small whatever the data's size.
    firsts = sums.select(
        part,
        F.expr(f"coalesce(sum(__n) over (order by {part} rows between unbounded preceding and 1 preceding), 0)").alias("__n0"),
        F.expr(f"coalesce(sum(__w) over (order by {part} rows between unbounded preceding and 1 preceding), 0)").alias("__w0"),
    )
    out = placed
    if weight:
        inner = F.expr(f"coalesce(sum({weight}) over (partition by {part} order by {mono} rows between unbounded preceding and 1 preceding), 0)")
        out = out.withColumn("__before", inner)
    out = out.join(F.broadcast(firsts), part).withColumn(name, F.col("__n0") + F.col(mono))
    if weight:
        out = out.withColumn(total, F.col("__w0") + F.col("__before")).drop("__before")
    return out.drop(part, mono, "__n0", "__w0")
