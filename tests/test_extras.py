"""Embedding, export, settings, stored indexes, backups and streaming control on small inputs."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import text
from gleaner.operators import chunking, embedding, export, manifest, ranking, sparse
from gleaner.plans import search
from gleaner.sources import graph_json
from gleaner.sources.store import Collection
from gleaner.streaming import ingest


def test_embedding_batches_and_retries(spark, tmp_path):
    seen = str(tmp_path / "calls")

    def flaky(texts):
        with open(seen, "a") as f:
            f.write(f"{len(texts)}\n")
        if sum(1 for _ in open(seen)) == 1:
            raise ConnectionError("not yet")
        return embedding.hashed(texts)

    rows = spark.createDataFrame([(i, None if i == 3 else "t" * i) for i in range(8)], "id int, text string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in embedding.embedded(rows, "text", flaky, rows=4, waits=(0.0, 0.0)).collect()}
    assert got[3] is None and np.allclose(got[5], embedding.hashed(["ttttt"])[0])
    assert [int(x) for x in open(seen)] == [4, 4, 3]
    assert list(map(len, embedding.batches(["x" * 10] * 5, rows=9, chars=20))) == [2, 2, 1]
    assert embedding.embedded(rows.filter("false"), "text").count() == 0


def test_settings(tmp_path):
    path = tmp_path / "settings.toml"
    path.write_text('[retrieval]\ntop_k = 7\n[extra]\nx = "y"\n')
    got = config.load(str(path), {"GLEANER_RETRIEVAL_TOKEN_BUDGET": "99", "GLEANER_REPOS_PATHS": "a, b,", "GLEANER_RETRIEVAL_SCORE_THRESHOLD": "0.5"})
    assert got["retrieval"]["top_k"] == 7 and got["retrieval"]["token_budget"] == 99 and got["retrieval"]["score_threshold"] == 0.5
    assert got["repos"]["paths"] == ["a", "b"] and got["extra"]["x"] == "y" and got["chunking"]["max_chars"] == 2000
    assert config.checked_request("q") == ("q", 10, 0.0)
    for bad in (("",), (" ",), ("q", 0), ("q", 51), ("q", 5, 1.5), ("q" * 10_001,)):
        with pytest.raises(ValueError):
            config.checked_request(*bad)


def test_notes_and_json_lines(spark, tmp_path):
    notes = spark.createDataFrame([("r/nodes/a.md", "# a"), ("r/nodes/b.md", "# b")], "path string, note string")
    export.write_notes(notes, str(tmp_path))
    assert (tmp_path / "r/nodes/a.md").read_text() == "# a"
    assert [json.loads(r[0]) for r in export.json_lines(notes.limit(1)).collect()] == [{"path": "r/nodes/a.md", "note": "# a"}]
    graph_json.write_summaries(spark.createDataFrame([("r", "1", "s")], "repo string, community string, summary string"), str(tmp_path / "s"))
    assert [tuple(r) for r in graph_json.read_summaries(spark, str(tmp_path / "s")).collect()] == [("r", "1", "s")]
    assert graph_json.parsed_nodes(spark.createDataFrame([("r", "{broken")], "repo string, document string")).count() == 0


def test_backups_keep_the_newest(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "store"))
    store.ensure("id long, x string")
    assert store.count() == 0
    for i in range(5):
        store.upsert(spark.createDataFrame([(i, "x")], "id long, x string"))
        kept = store.backup(str(tmp_path / "backups"), f"2024010{i}_000000")
    assert kept == ["20240104_000000", "20240103_000000", "20240102_000000"]
    store.restore(str(tmp_path / "backups"), "20240103_000000")
    assert store.count() == 4


def test_stored_index_is_refitted(spark, tmp_path):
    rows = [(1, "a b b"), (2, "b c"), (3, "c c d")]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    tokens = text.tokenize(F.col("text"))
    old = sparse.fitted(frame(rows), "doc_id", tokens, str(tmp_path / "one"))
    got = sparse.refitted(old, frame([(3, "")]), frame([(2, "b é"), (4, "a d")]), 3, "doc_id", tokens, str(tmp_path / "two"))
    want = sparse.fitted(frame([(1, "a b b"), (2, "b é"), (4, "a d")]), "doc_id", tokens, str(tmp_path / "three"))
    for a, b in zip(got, want):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sorted(map(tuple, sparse.loaded(spark, str(tmp_path / "two")).stats.collect())) == sorted(map(tuple, got.stats.collect()))


def test_keyword_variants(spark):
    asked = spark.createDataFrame([(1, "river boats"), (2, "the of and"), (3, "What are River boats?"), (4, "")], "query_id long, text string")
    got = sorted(tuple(r) for r in search.asked_variants(asked).collect())
    assert got == [(1, 0, "river boats"), (2, 0, "the of and"), (3, 0, "What are River boats?"), (3, 1, "river boats"), (4, 0, "")]


def test_multi_strategy_scores_a_keyword_query_once(spark, tmp_path, sf_dir):
    """Texts that are keywords alone, and of stop-words alone, against the SQL."""
    word = spark.read.parquet(f"{sf_dir}/documents.parquet").first()["text"].split()[0].strip(".,").lower()
    spark.createDataFrame([(1, f"{word} {word}boat"), (2, "the and of the"), (3, f"What is {word} of the?")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    df = search.multi_strategy(spark, str(tmp_path))
    rel = con.execute(search.query.__globals__["ORACLES"]["multi_strategy"])
    names = [d[0] for d in rel.description]
    want = sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rel.fetchall())
    assert want and sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in (r[n] for n in names)) for r in df.collect()) == want


def test_dense_pairs_in_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [0.0, 0.0] if i == 5 else rng.normal(size=2).round(1).tolist()) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.filter("vec_id < 9").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    ranking.QUERY_BLOCK, old = 4, ranking.QUERY_BLOCK
    try:
        every = {(r[0], r[1]): r[2] for r in ranking.dense_pairs(vectors, queries, 60).collect()}
        best = ranking.dense_pairs(vectors, queries, 3).collect()
    finally:
        ranking.QUERY_BLOCK = old
    assert len(every) == 8 * 59 and ranking.dense_pairs(vectors, queries.filter("false"), 3).count() == 0
    for q in range(9):
        want = sorted(((-s, v) for (a, v), s in every.items() if a == q))[:3]
        assert sorted((-r["score"], r["vec_id"]) for r in best if r["query_id"] == q) == want


def test_failed_batches_are_told_and_the_next_goes_on(spark, tmp_path):
    for i, body in enumerate(("good " * 30, "bad " * 30, "fine " * 30)):
        spark.createDataFrame([(f"n{i}.md", f"n{i}", body)], "path string, stem string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def chunk(batch):
        if batch.filter(F.col("text").startswith("bad")).count():
            raise ValueError("a bad file")
        return chunking.chunk_notes(batch)

    store = Collection(spark, str(tmp_path / "store"), key="chunk_id")
    query = ingest.ingest(ingest.note_stream(spark, str(tmp_path / "in"), files_a_batch=1), chunk, store, str(tmp_path / "c"), errors=str(tmp_path / "errors"))
    assert ingest.watched(query, 120)
    assert store.count() == 2 and [(r["path"], r["error"]) for r in spark.read.json(str(tmp_path / "errors")).collect()] == [("n1.md", "a bad file")]


def test_runs(spark):
    none = spark.createDataFrame([], "run_id string, started_at timestamp, finished_at timestamp, status string, error string")
    runs = manifest.started(none, spark.sql("select 'a' as run_id, timestamp'2024-01-01' as started_at union all select 'b', timestamp'2024-01-02'"))
    ended = spark.sql("select 'a' as run_id, timestamp'2024-01-03' as finished_at, 'failed' as status, 'disk' as error")
    assert sorted((r["run_id"], r["status"], r["error"]) for r in manifest.finished(runs, ended).collect()) == [("a", "failed", "disk"), ("b", "running", None)]


def test_two_places_of_the_binary_value(spark):
    import duckdb

    values = [0.125, 0.285, 0.375, 0.145, 0.005, -0.001, 0.995, 1.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(text.two_places(F.col("v"))).collect()
    assert [r[0] for r in got] == [duckdb.execute("select printf('%.2f', ?::double)", [v]).fetchone()[0] for v in values]
    gate = ranking.relevance_gate(spark.createDataFrame([(1, 0.125)], "query_id long, score double"), ["query_id"], "score").first()
    assert gate["reason"] == "best score 0.12 is below 0.50"


def test_what_follows_a_search_has_all_vectors(spark, tmp_path):
    """Not the first 30 of a question alone: groups, counts and bests are those of every pair."""
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 41 == 7 else i % 3, rng.normal(size=2).tolist()) for i in range(130)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    scores = lambda q: {i: (label, round(float(np.dot(v, rows[q][2]) / np.linalg.norm(v) / np.linalg.norm(rows[q][2])), 6)) for i, label, v in rows}
    want = [(q, i, *s) for q in (0, 100) for i, s in scores(q).items()]
    ranking.QUERY_BLOCK, old = 1, ranking.QUERY_BLOCK
    try:
        got = {name: [tuple(r) for r in search.__dict__[name](spark, str(tmp_path)).collect()] for name in ("dedup_best", "dyn_threshold", "relevance_gate", "context_blocks")}
    finally:
        ranking.QUERY_BLOCK = old
    groups = {}
    for q, i, label, s in want:
        groups.setdefault((q, label), []).append((-s, i))
    assert {(q, label): n for q, label, n, *_ in got["relevance_gate"]} == {g: len(m) for g, m in groups.items()} and sum(map(len, groups.values())) == 260
    assert len(got["dedup_best"]) == len({(q, label, i % 50) for q, i, label, _ in want})
    kept = {(q, i) for (q, label), m in groups.items() for s, i in m if -s >= max(0.2, 0.75 * -min(m)[0])}
    assert {(q, i) for q, i, _ in got["dyn_threshold"]} == kept and len(kept) > 60
    told = {(q, label): block.count("\n") + 1 for q, label, block in got["context_blocks"]}
    assert told == {g: min(5, len(m)) for g, m in groups.items()}
