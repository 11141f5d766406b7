"""Incremental ingest and resource watching as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.operators import governor
from gleaner.sources.store import Collection


def ingest(files: DataFrame, chunk: Callable[[DataFrame], DataFrame], store: Collection, checkpoint: str, every: str | None = None, errors: str | None = None) -> StreamingQuery:
    """Chunk the files of each micro-batch and upsert the chunks by id: a batch that runs again changes nothing.

    What is there is read at once and the query ends; with ``every`` it goes on, a batch in each such time. With
    ``errors``, a folder of JSON, a batch that fails is told there (its number, files and error) and the next goes on;
    else it ends the query.
    """

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        try:
            store.upsert(chunk(batch))
        except Exception as error:  # a model, parser or store may fail in any way
            if errors is None:
                raise
            told = batch.select("path").withColumns({"batch": F.lit(number), "error": F.lit(str(error)[:2000])})
            told.write.mode("append").json(errors)

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def watched(query: StreamingQuery, seconds: float) -> bool:
    """Let a query run for so long at most; whether it ended by itself."""
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)


def note_stream(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """New Parquet files of notes (``path, stem, text``), so many in a micro-batch; edits in place are found by a snapshot
    comparison instead."""
    reader = spark.readStream.schema("path string, stem string, text string")
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)


def windowed_load(samples: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean and greatest load of each machine in each window; samples may be late."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", width), "machine").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("ram_percent"), 6).alias("mean"), F.max("ram_percent").alias("greatest"))


def swap_deltas(samples: DataFrame) -> DataFrame:
    """``machine, ts, swap_delta_gb`` against the machine's last sample, which is kept as state between batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("ts")
        last = state.get[0] if state.exists else rows["swap_used_gb"].iloc[0]
        before = rows["swap_used_gb"].shift(1, fill_value=last)
        state.update((float(rows["swap_used_gb"].iloc[-1]),))
        yield pd.DataFrame({"machine": key[0], "ts": rows["ts"], "swap_delta_gb": (rows["swap_used_gb"] - before).round(3)})

    return samples.groupBy("machine").applyInPandasWithState(step, "machine long, ts timestamp, swap_delta_gb double", "last double", "append", GroupStateTimeout.NoTimeout)


def watch(samples: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """Decide on every sample without state: all rules but the growth of swap, which ``swap_deltas`` gives."""
    decided = samples.withColumn("action", governor.action(F.lit(0.0)))
    return decided.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
