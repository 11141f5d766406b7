"""One ingest of notes into a collection, counted while it runs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.functions.text import estimated_tokens
from gleaner.operators import chunking, embedding
from gleaner.operators.ordering import checkpoint_folder, checkpointed
from gleaner.sources.store import Collection

#: The counter of each state of a file.
STATES = {"parsed": "files_parsed", "skipped": "files_skipped", "error": "errors"}


def classified(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Add ``sha256``, ``state`` and ``error`` to files (``path, text``): an error where no text could be read, skipped where
    the manifest (``path, sha256``) has the same digest, else parsed."""
    known = seen.select("path", F.col("sha256").alias("__seen"))
    told = files.withColumn("sha256", F.sha2("text", 256)).join(known, "path", "left")
    state = F.when(F.col("text").isNull(), "error").when(F.col("sha256") == F.col("__seen"), "skipped").otherwise("parsed")
    return told.withColumn("state", state).withColumn("error", F.when(F.col("state") == "error", "no text could be read")).drop("__seen")


def outdated(stored: DataFrame, files: DataFrame, passages: DataFrame) -> DataFrame:
    """Stored passages (``source_path, chunk_id``) of parsed files that these no longer have."""
    parsed = files.filter("state = 'parsed'").select(F.col("path").alias("source_path"))
    return stored.join(parsed, "source_path", "left_semi").join(passages.select("chunk_id"), "chunk_id", "left_anti")


def ingested(files: DataFrame, seen: DataFrame, store: Collection, embed: Callable[[list[str]], np.ndarray] = embedding.hashed) -> tuple[dict[str, float], DataFrame, DataFrame]:
    """Parse new and changed notes (``path, stem, text``), embed and store their passages and delete those they lost.

    Returns the counters of the run with its seconds, a row for each file that failed (``path, error``), and the manifest
    after it (``path, sha256``), in which failed files keep their last digest, so that they are tried again. Files and
    passages are counted by the jobs that write them for the later steps, not by jobs of their own. One file that fails
    stops no other; a run that was cut off is run again as a whole.
    """
    spark, began = files.sparkSession, time.monotonic()
    folder = f"{checkpoint_folder(spark)}/ingest-{uuid.uuid4().hex}"
    of_files, of_passages = Observation(), Observation()
    counts = [F.count_if(F.col("state") == state).alias(name) for state, name in STATES.items()]
    classified(files, seen).observe(of_files, F.count(F.lit(1)).alias("files_scanned"), *counts).write.parquet(f"{folder}/files")
    states = spark.read.parquet(f"{folder}/files")
    made = embedding.embedded(chunking.chunk_notes(states.filter("state = 'parsed'")), "embedding_text", embed)
    size = F.coalesce(F.sum(F.length("display_text")), F.lit(0)).alias("chars"), F.coalesce(F.sum(estimated_tokens(F.col("display_text"))), F.lit(0)).alias("tokens")
    made.observe(of_passages, F.count(F.lit(1)).alias("chunks_produced"), F.count("embedding").alias("chunks_embedded"), *size).write.parquet(f"{folder}/passages")
    passages = spark.read.parquet(f"{folder}/passages")
    whole = passages.filter("embedding is not null")
    gone = checkpointed(outdated(store.read(), states, passages).select("chunk_id")) if store.healthy() else None
    store.upsert(whole)
    counters = {**of_files.get, **of_passages.get, "chunks_stored": whole.select("chunk_id").distinct().count(), "stale_deleted": store.delete(gone) if gone is not None else 0}
    done = states.filter("state <> 'error'").select("path", "sha256")
    kept = seen.select("path", "sha256").join(done.select("path"), "path", "left_anti")
    return {**counters, "elapsed_seconds": time.monotonic() - began}, states.filter("state = 'error'").select("path", "error"), done.unionByName(kept)


def counters(files: DataFrame, passages: DataFrame, gone: DataFrame, by: str) -> DataFrame:
    """The counters of a run for each value of a column of its files (``by, path, state``)."""
    of = files.select("path", by)
    each = lambda rows, *aggs: rows.join(of, F.col("source_path") == F.col("path")).groupBy(by).agg(*aggs)
    scanned = files.groupBy(by).agg(F.count(F.lit(1)).alias("files_scanned"), *(F.count_if(F.col("state") == s).alias(n) for s, n in STATES.items()))
    text = F.col("display_text")
    made = each(passages, F.count(F.lit(1)).alias("chunks_produced"), F.count("embedding").alias("chunks_embedded"), F.countDistinct(F.when(F.col("embedding").isNotNull(), F.col("chunk_id"))).alias("chunks_stored"), F.sum(F.length(text)).alias("chars"), F.sum(estimated_tokens(text)).alias("tokens"))
    lost = each(gone, F.count(F.lit(1)).alias("stale_deleted"))
    return scanned.join(made, by, "left").join(lost, by, "left").fillna(0)
