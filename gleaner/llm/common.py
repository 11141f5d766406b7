"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.ordering import checkpoint_folder, checkpointed, shuffle_partitions, stored, with_row_number

__all__ = ["checkpoint_folder", "checkpointed", "join_spread", "read_table", "shuffle_partitions", "stored", "with_row_number"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more rows than this, and than one in so many of all rows, is joined by a broadcast of its one row.
HOT_ROWS, HOT_SHARE = 1000, 100_000


def join_spread(left: DataFrame, right: DataFrame, key: str, copies: str) -> DataFrame:
    """``left.join(right, key)`` where ``right`` has one row a key and tells in ``copies`` how many rows ``left`` has of it.

    Keys with many rows never meet in one task: at most ``HOT_SHARE`` of them can be hot, whatever the data, and those
    rows of ``right`` are broadcast. ``copies`` is dropped.
    """
    rows = right.agg(F.sum(copies)).first()[0] or 0
    hot = F.col(copies) > max(HOT_ROWS, rows // HOT_SHARE)
    few, rest = right.filter(hot).drop(copies), right.filter(~hot).drop(copies)
    if few.isEmpty():
        return left.join(rest, key)
    cold = left.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key)
    return left.join(F.broadcast(few), key).select(*cold.columns).unionByName(cold)
