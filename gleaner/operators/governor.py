"""Decisions from resource samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = ("CONTINUE", "THROTTLE", "REDUCE", "PAUSE", "ABORT")


def action(delta: Column, max_cpu: int = 75) -> Column:
    """The first rule that holds decides; ``delta`` is the growth of used swap since the last sample."""
    c = F.col
    rules = (
        (c("disk_free_gb") < 1, "ABORT"), (c("ram_percent") >= 90, "ABORT"), (c("swap_percent") >= 80, "ABORT"),
        (c("swap_percent") >= 60, "PAUSE"), (c("ram_percent") >= 80, "PAUSE"), (c("swap_percent") >= 40, "REDUCE"),
        (c("ram_percent") >= 70, "REDUCE"), (delta > 0.5, "THROTTLE"), (c("psi_memory") > 25, "PAUSE"), (c("psi_memory") > 10, "REDUCE"),
        (c("psi_io") > 40, "PAUSE"), (c("psi_io") > 20, "REDUCE"), ((c("psi_memory") > 5) | (c("psi_io") > 10), "THROTTLE"),
        (c("cpu_percent") > max_cpu + 10, "THROTTLE"), (c("psi_cpu") > 50, "THROTTLE"),
    )
    out = F.when(*((rules[0][0], rules[0][1])))
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise("CONTINUE")


def actions(samples: DataFrame, by: str, ts: str) -> DataFrame:
    """Add ``swap_delta_gb`` and ``action`` to each sample of each machine."""
    delta = F.coalesce(F.col("swap_used_gb") - F.lag("swap_used_gb").over(Window.partitionBy(by).orderBy(ts, "sample_id")), F.lit(0.0))
    return samples.withColumn("swap_delta_gb", F.round(delta, 3)).withColumn("action", action(F.col("swap_delta_gb")))


def advice(decided: Column) -> Column:
    """struct(pause_sync, reduce_workers) for a decision."""
    return F.struct(decided.isin("PAUSE", "ABORT").alias("pause_sync"), decided.isin("REDUCE", "THROTTLE").alias("reduce_workers"))


def tuned(cores: Column, total: Column, free: Column, vram: Column, workers: int = 2) -> Column:
    """struct(jobs, batch, parsers) that suit a machine's cores and memory (GB)."""
    jobs = F.greatest(F.lit(1), F.least(F.floor(cores / 6).cast("int"), F.lit(4)))
    batch = F.when(total < 8, 15).when(total < 16, 25).otherwise(30)
    batch = F.when(vram >= 6, F.greatest(batch, F.lit(50))).otherwise(batch)
    parsers = F.when(free < 8, 1).when(free < 16, min(2, workers)).otherwise(F.least(F.lit(3), F.greatest(F.lit(1), F.floor(cores / 8).cast("int"))))
    low = free < 4
    return F.struct(
        F.when(low, F.greatest(F.lit(1), F.floor(jobs / 2).cast("int"))).otherwise(jobs).alias("jobs"),
        F.when(low, F.greatest(F.lit(10), F.floor(batch / 2).cast("int"))).otherwise(batch).alias("batch"), F.when(low, 1).otherwise(parsers).alias("parsers"),
    )


def pressure_line(line: Column) -> Column:
    """A map of the numbers in a pressure line such as ``some avg10=0.50 avg60=0.20 total=12``."""
    pairs = F.filter(F.split(F.trim(line), r"\s+"), lambda p: p.rlike(r"^[^=]+=[0-9.]+$"))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.substring_index(p, "=", -1).cast("double"))))
