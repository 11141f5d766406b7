"""Snapshots, manifests and incremental change as joins and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE_FIELDS = ("mtime", "size", "sha256")


def needs_reindex(snapshot: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Files of a snapshot that the manifest lacks or knows otherwise, and why."""
    known = manifest.select(F.col(key), F.lit(True).alias("__known"), *(F.col(f).alias(f"__{f}") for f in FILE_FIELDS))
    joined = snapshot.join(known, key, "left")
    reason = F.when(F.col("__known").isNull(), "new")
    for f in FILE_FIELDS:
        reason = reason.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), f)
    return joined.withColumn("reason", reason).filter("reason is not null").select(*snapshot.columns, "reason")


def stale(stored: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """Stored rows that are no longer valid; nothing is stale while the valid set is empty."""
    guard = valid.agg(F.count(F.lit(1)).alias("__valid"))
    return stored.join(valid.select(key).distinct(), key, "left_anti").crossJoin(F.broadcast(guard)).filter("__valid > 0").drop("__valid")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key; of repeated new rows the last in order ``ord``."""
    latest = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ord")))).filter("__n = 1").drop("__n", "ord")
    return old.join(latest.select(key), key, "left_anti").unionByName(latest)


def replaced(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """All rows of the groups in ``new`` are replaced by its rows."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def deleted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def marked(rows: DataFrame, keys: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """Set a column in the rows that are listed."""
    listed = keys.select(key).distinct().withColumn("__listed", F.lit(True))
    return rows.join(listed, key, "left").withColumn(column, F.when(F.col("__listed"), F.lit(value)).otherwise(F.col(column))).drop("__listed")


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, differs: Column) -> DataFrame:
    """``key, change`` (new, deleted, changed, same); ``differs`` compares ``before.`` and ``after.`` columns."""
    b, a = before.alias("before"), after.alias("after")
    joined = b.join(a, F.col(f"before.{key}") == F.col(f"after.{key}"), "full_outer")
    change = F.when(F.col(f"before.{key}").isNull(), "new").when(F.col(f"after.{key}").isNull(), "deleted").when(differs, "changed").otherwise("same")
    return joined.select(F.coalesce(F.col(f"before.{key}"), F.col(f"after.{key}")).alias(key), change.alias("change"))


def build_decision(force: Column, exists: Column, auto_update: Column, code: Column, docs: Column) -> Column:
    """What to do about a graph: extract, update (code only) or skip."""
    return F.when(force | ~exists, "extract").when(~auto_update | (~code & ~docs), "skip").when(code & ~docs, "update").otherwise("extract")


def started(runs: DataFrame, new: DataFrame) -> DataFrame:
    """``runs`` (``run_id, started_at, finished_at, status, error``) with the new ones (``run_id, started_at``) running."""
    fresh = new.select("run_id", "started_at", F.lit(None).cast("timestamp").alias("finished_at"), F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"))
    return runs.unionByName(fresh)


def finished(runs: DataFrame, ended: DataFrame) -> DataFrame:
    """Runs with what ``ended`` (``run_id, finished_at, status, error``, one row a run) tells of them."""
    told = ended.select("run_id", F.col("finished_at").alias("__at"), F.col("status").alias("__status"), F.col("error").alias("__error"), F.lit(True).alias("__ended"))
    joined = runs.join(told, "run_id", "left")
    now = lambda column, new: F.when(F.col("__ended"), F.col(new)).otherwise(F.col(column)).alias(column)
    return joined.select("run_id", "started_at", now("finished_at", "__at"), now("status", "__status"), now("error", "__error"))


def ids_of(rows: DataFrame, key: str, **equal: object) -> DataFrame:
    """The keys of the rows with these values: chunks of a repository or file, files of a repository."""
    for column, value in equal.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    return rows.select(key)


def of_vault(rows: DataFrame, name: str, column: str = "source_name") -> DataFrame:
    """The rows of the vault of this name, case aside."""
    return rows.filter(F.lower(column) == name.lower())
