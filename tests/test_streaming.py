"""Streaming jobs on small folders."""

from pyspark.sql import functions as F

from gleaner.operators import chunking, graph
from gleaner.sources.store import Collection
from gleaner.streaming import ingest

BODY = "A sentence that is long enough to be kept as a passage. " * 2


def test_ingest_is_idempotent(spark, tmp_path):
    notes = spark.createDataFrame([(f"n{i}.md", f"n{i}", BODY + str(i)) for i in range(3)], "path string, stem string, text string")
    notes.write.parquet(str(tmp_path / "in"))
    store = Collection(spark, str(tmp_path / "store"), key="chunk_id")
    for folder in ("one", "one", "two"):  # the second run finds nothing new, the third starts over
        ingest.ingest(ingest.note_stream(spark, str(tmp_path / "in")), chunking.chunk_notes, store, str(tmp_path / folder)).awaitTermination()
    assert store.count() == 3


def test_swap_deltas_and_windows(spark, tmp_path):
    rows = spark.sql("select id as sample_id, id % 2 as machine, timestamp_seconds(id * 60) as ts, cast(id as double) / 4 as swap_used_gb, cast(id as double) as ram_percent from range(10)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = ingest.swap_deltas(stream).writeStream.format("memory").queryName("deltas").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r[0] for r in spark.sql("select swap_delta_gb from deltas").collect()) == [0.0] * 2 + [0.5] * 8
    query = ingest.windowed_load(stream).writeStream.format("memory").queryName("load").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("load").agg(F.sum("samples")).first()[0] == 10


def test_structural_context(spark):
    nodes = spark.createDataFrame([("r", "a", "run()", "x/a.py", "1", 0), ("r", "b", "load", "x/b.py", "1", 1), ("r", "c", "save", "x/c.py", "2", 2)], "repo string, id string, label string, source_file string, community string, ord int")
    edges = spark.createDataFrame([("r", 0, "a", "b", "calls", 1.0), ("r", 1, "c", "a", "uses", 1.0), ("r", 2, "a", "c", "contains", 1.0)], "repo string, ord int, source string, target string, relation string, weight double")
    rows = [(1, "r", "app/x/a.py", "run (parte 2)", 1), (2, "r", "x/c.py", "save", 2), (3, "r", "nowhere.py", "run", 3)]
    asked = [(q, *row, 1000) for q in (7, 8) for row in rows if q == 7 or row[0] == 2]  # the second question has one of the passages
    chunks = spark.createDataFrame(asked, "query_id int, chunk_id int, repo string, source_path string, section_header string, rank int, budget int")
    summaries = spark.createDataFrame([("r", "1", "runs things")], "repo string, community string, summary string")
    gods = spark.createDataFrame([("r", "a")], "repo string, id string")
    told = graph.structural_context(chunks, nodes, edges, summaries, gods).orderBy("query_id").collect()
    assert told[1]["query_id"] == 8 and told[1]["block"] == "[CONTEXTO ESTRUTURAL — r]\nsave (x/c.py):\n  chama/usa: run() (uses)\n[/CONTEXTO ESTRUTURAL — r]"
    assert [r["block"] for r in told[:1]] == ["[CONTEXTO ESTRUTURAL — r]\nComunidade 1: runs things\nrun() (app/x/a.py) [god-node]:\n  chama/usa: load (calls)\n  chamado por: save (uses)\nsave (x/c.py):\n  chama/usa: run() (uses)\n[/CONTEXTO ESTRUTURAL — r]"]
