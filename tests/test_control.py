"""Streams with state and timers over files, with restarts from the checkpoint."""

import datetime as dt

from gleaner.streaming import control


def add(spark, folder, rows, schema):
    table = spark.createDataFrame([(m, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), x) for m, s, x in rows], schema)
    table.coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, schema, job):
    """All there is in the folder now; a later run goes on from the checkpoint of the last."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = job(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return sorted(tuple(v.second + 60 * v.minute if hasattr(v, "minute") else v for v in r) for r in spark.read.parquet(str(tmp_path / "out")).collect())


DECIDED, READ = "machine long, ts timestamp, action string", "machine long, ts timestamp, value double"


def test_batches_stay_halved_over_restarts(spark, tmp_path):
    folder = str(tmp_path / "in")
    add(spark, folder, [(1, 0, "CONTINUE"), (1, 1, "REDUCE"), (1, 2, "CONTINUE"), (2, 0, "PAUSE")], DECIDED)
    job = lambda s: control.latched_batches(s, 30)
    assert run(spark, tmp_path, DECIDED, job) == [(1, 0, "CONTINUE", 30), (1, 1, "REDUCE", 15), (1, 2, "CONTINUE", 15), (2, 0, "PAUSE", 30)]
    add(spark, folder, [(1, 3, "THROTTLE"), (1, 4, "REDUCE"), (1, 5, "CONTINUE")], DECIDED)
    assert run(spark, tmp_path, DECIDED, job)[3:6] == [(1, 3, "THROTTLE", 7), (1, 4, "REDUCE", 5), (1, 5, "CONTINUE", 5)]


def test_gate_opens_on_a_decision_or_a_timeout(spark, tmp_path):
    folder = str(tmp_path / "in")
    add(spark, folder, [(1, 0, "PAUSE"), (1, 5, "PAUSE"), (2, 0, "PAUSE"), (3, 0, "CONTINUE")], DECIDED)
    job = lambda s: control.safe_openings(s, 30_000)
    assert run(spark, tmp_path, DECIDED, job) == []
    add(spark, folder, [(1, 10, "REDUCE"), (3, 100, "PAUSE"), (3, 101, "ABORT")], DECIDED)  # time goes on; the second machine is silent
    assert run(spark, tmp_path, DECIDED, job) == [(1, 0, 10, "REDUCE", "decision"), (2, 0, 30, "PAUSE", "timeout"), (3, 100, 101, "ABORT", "decision")]


def test_sampler_tells_the_last_reading_of_an_interval(spark, tmp_path):
    folder = str(tmp_path / "in")
    add(spark, folder, [(1, 0, 1.0), (1, 4, 2.0), (1, 9, 3.0), (2, 0, 9.0)], READ)
    job = lambda s: control.sampled(s, 10_000)
    assert run(spark, tmp_path, READ, job) == []
    add(spark, folder, [(1, 12, 4.0), (1, 35, 5.0)], READ)
    assert run(spark, tmp_path, READ, job) == [(1, 10, 9, 3.0), (1, 20, 12, 4.0), (2, 10, 0, 9.0)]
