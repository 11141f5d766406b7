"""Expected values of scalar functions."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import governor, ranking, sparse
from gleaner.plans import registry, search
from gleaner.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("given", "want"), [("Hello World", ["hello", "world"]), ("my_func", ["my_func"]), ("v1.2 abc123", ["v1", "2", "abc123"]), ("   ", []), ("Café ﬁn", ["cafe", "fin"])])
def test_tokenize(spark, given, want):
    assert one(spark, given, text.tokenize) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("zsh aliases", "simple"), ("como configurar aliases no zsh", "normal"), ("docker and kubernetes setup", "complex"), ("o que é? como funciona?", "complex")],
)
def test_complexity(spark, given, want):
    assert one(spark, given, text.complexity) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("Quais são as minhas notas sobre Python?", "RAG_ONLY"), ("Quais módulos do meu projeto dependem do config?", "RAG_AND_GRAPH"), ("O que é um grafo de dependências?", "NO_CONTEXT"), ("", "NO_CONTEXT")],
)
def test_route(spark, given, want):
    assert one(spark, given, lambda c: text.heuristic_route(c)["mode"]) == want


def test_scaled_k(spark):
    sizes = spark.createDataFrame([(500,), (1000,), (10_000,), (100_000,)], "n long")
    assert [r[0] for r in sizes.select(text.scaled_k(F.lit(10), F.col("n"))).collect()] == [10, 10, 20, 30]


def test_navigation(spark):
    assert one(spark, "- [[a]]\n* [[b]]\n[[c]]", text.only_links)
    assert not one(spark, "Plain prose\nand more", text.only_links)
    assert one(spark, "", text.only_links)


def test_front_matter_only_at_the_start(spark):
    assert one(spark, "---\na: b\n---\nbody\n---\nc\n---\n", text.without_front_matter) == "body\n---\nc\n---"


def test_labels(spark):
    assert one(spark, "Process_One (parte 2)", text.normal_label) == "process_one"
    assert one(spark, ".main.py (module-level)", text.normal_label) == "main.py"
    assert one(spark, "run()", text.normal_label) == "run"


def test_budget_shares_never_exceed_the_total(spark):
    flags = spark.createDataFrame([(n, c, g) for n in (True, False) for c in (True, False) for g in (True, False)], "n boolean, c boolean, g boolean")
    shares = flags.select("n", "c", "g", text.budget_share(F.lit(4001), F.col("n"), F.col("c"), F.col("g")).alias("b")).collect()
    for r in shares:
        assert sum(r["b"]) <= 4001 and all((v > 0) == on for v, on in zip(r["b"], (r["n"], r["c"], r["g"])))


def test_pressure_line(spark):
    assert one(spark, "some avg10=0.50 avg60=0.20 avg300=0.05 bad=x total=12345", governor.pressure_line) == {"avg10": 0.5, "avg60": 0.2, "avg300": 0.05, "total": 12345.0}


@pytest.mark.parametrize(
    ("changed", "want"),
    [({"disk_free_gb": 0.5}, "ABORT"), ({"swap_percent": 80.0}, "ABORT"), ({"swap_percent": 60.0, "ram_percent": 70.0}, "PAUSE"), ({"ram_percent": 70.0}, "REDUCE"), ({"psi_io": 21.0}, "REDUCE"), ({"cpu_percent": 86.0}, "THROTTLE"), ({}, "CONTINUE")],
)
def test_governor(spark, changed, want):
    calm = {"disk_free_gb": 50.0, "ram_percent": 10.0, "swap_percent": 0.0, "psi_memory": 0.0, "psi_io": 0.0, "psi_cpu": 0.0, "cpu_percent": 5.0}
    assert spark.createDataFrame([{**calm, **changed}]).select(governor.action(F.lit(0.0))).first()[0] == want


def test_swap_storm(spark):
    row = {"disk_free_gb": 50.0, "ram_percent": 10.0, "swap_percent": 0.0, "psi_memory": 0.0, "psi_io": 0.0, "psi_cpu": 0.0, "cpu_percent": 5.0}
    assert spark.createDataFrame([row]).select(governor.action(F.lit(0.6))).first()[0] == "THROTTLE"


@pytest.mark.parametrize(
    ("path", "want"),
    [("src/a.py", True), ("venv3/a.py", False), ("x.egg-info/b.md", False), ("a/logo.PNG", False), ("Makefile", False), ("docs/index.MD", True), ("build/c.py", False), ("build", False), ("env/x.go", False), ("lib/x.rs", True)],
)
def test_repository_paths(spark, path, want):
    assert one(spark, path, files.indexed) is want


def test_bm25_prefers_rare_terms_and_short_documents(spark):
    docs = spark.createDataFrame([(0, "the cat sat"), (1, "the dog sat on the mat"), (2, "the fox"), (3, "cats")], "doc_id long, text string")
    counts = sparse.term_counts(docs, "doc_id", text.tokenize(F.col("text")))
    stats = sparse.corpus_stats(docs, counts)
    weights = sparse.term_weights(counts, stats)
    idf = {r["term"]: r["idf"] for r in weights.collect()}
    assert idf["cats"] > idf["the"] > 0
    index = {(r["doc_id"], r["term"]): r["weight"] for r in sparse.document_weights(counts, weights, stats, "doc_id").collect()}
    assert index[0, "sat"] > index[1, "sat"]
    places = {r["term"]: r["term_index"] for r in sparse.vocabulary(weights).collect()}
    assert [t for t, _ in sorted(places.items(), key=lambda x: x[1])] == sorted(idf) and sorted(places.values()) == list(range(len(idf)))


def test_budget_keeps_the_first_row(spark):
    rows = spark.createDataFrame([(1, 1, "a b c d e f g h"), (1, 2, "a"), (2, 1, "a b"), (2, 2, "c"), (2, 3, "d e f g h i")], "q int, n int, text string")
    kept = ranking.within_budget(rows, ["q"], "text", 5, F.col("n")).select("q", "n").collect()
    assert sorted(map(tuple, kept)) == [(1, 1), (2, 1), (2, 2)]


def test_postings_in_place(spark):
    """Terms are counted in the rows of their texts, ids that are repeated in all of theirs together."""
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, "c a"), (3, "a"), (4, None), (None, "x"), (None, "x y")], "doc_id long, text string")
    got = sorted(map(tuple, sparse.postings(docs, "doc_id", text.tokenize(F.col("text"))).collect()), key=repr)
    assert got == sorted([(1, 3, "a", 1), (1, 3, "b", 2), (3, 3, "a", 2), (3, 3, "c", 1), (None, 3, "x", 2), (None, 3, "y", 1)], key=repr)
    plan = sparse.postings(docs.filter("doc_id = 1"), "doc_id", text.tokenize(F.col("text")))._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_bm25_vectors_of_many_terms(spark, tmp_path):
    """Terms of very many documents have the weights that the SQL gives when there are too many terms to send them all out."""
    import duckdb

    rows = [(i, f"the {'the ' * (i % 3)}river w{i} w{i // 2}") for i in range(12)] + [(12, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLES["bm25_vectors"]).fetchall())
    bounds = sparse.BROADCAST_TERMS, sparse.COMMON_TERM
    try:
        sparse.BROADCAST_TERMS, sparse.COMMON_TERM = 4, 5
        got = sorted(map(tuple, search.bm25_vectors(spark, str(tmp_path)).collect()))
    finally:
        sparse.BROADCAST_TERMS, sparse.COMMON_TERM = bounds
    assert len(want) == 47 and all(w for _, _, w in got)
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(g[2] - w[2]) < 1e-5 for g, w in zip(got, want))


def test_document_weights_go_one_way_at_any_size(spark):
    """Neither rows nor plan depend on how the number of terms compares with the bounds."""
    docs = spark.createDataFrame([(i, f"the {'the ' * (i % 3)}river w{i} w{i // 2}") for i in range(12)], "doc_id long, text string")
    counts = sparse.postings(docs, "doc_id", text.tokenize(F.col("text"))).localCheckpoint()
    stats = sparse.corpus_stats(docs, counts).localCheckpoint()
    weights = sparse.term_weights(counts, stats).localCheckpoint()
    asked, bounds, every, plans = weights.filter("term < 'w'").select("term"), (sparse.BROADCAST_TERMS, sparse.COMMON_TERM), [], []
    try:
        for sparse.BROADCAST_TERMS, sparse.COMMON_TERM in (bounds, (4, 5), (1, 0), (40, 1)):
            for some in (counts, counts.drop("length")):
                index = sparse.document_weights(some, weights, stats, "doc_id")
                picked = sparse.document_weights(some, weights, stats, "doc_id", asked)
                every.append([sorted((d, t, round(w, 9)) for d, t, w in x.collect()) for x in (index, picked)])
                plans.append(index._jdf.queryExecution().optimizedPlan().toString().count("Union"))
    finally:
        sparse.BROADCAST_TERMS, sparse.COMMON_TERM = bounds
    assert len(every[0][0]) == 47 and every[0][1] == [r for r in every[0][0] if r[1] < "w"] and len(every[0][1]) == 24
    assert all(x == every[0] for x in every) and set(plans) == {1}


def test_sparse_best_is_the_head_of_all_scores(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(90)], "doc_id long, text string")
    counts = sparse.postings(docs, "doc_id", text.tokenize(F.col("text"))).localCheckpoint()
    stats = sparse.corpus_stats(docs, counts)
    weights = sparse.term_weights(counts, stats)
    asked = sparse.term_counts(spark.createDataFrame([(q, " ".join(rng.choices([*words, "no"], k=4))) for q in range(7)], "q int, text string"), "q", text.tokenize(F.col("text")))
    index, queries = sparse.document_weights(counts, weights, stats, "doc_id", asked.select("term")), sparse.query_weights(asked, weights, "q").withColumn("asked", F.struct("q"))
    every = {}
    for r in sparse.sparse_scores(index, queries, "doc_id", "asked").collect():
        every.setdefault(r["asked"]["q"], []).append((-r["score"], r["doc_id"]))
    want = {(q, d, n, -s) for q, m in every.items() for n, (s, d) in enumerate(sorted(m)[:5], 1)}
    cells = sparse.MATRIX_CELLS
    try:
        for sparse.MATRIX_CELLS in (cells, 400, 10):  # one batch, batches of a few documents, no matrix
            best = sparse.sparse_best(index, queries, "doc_id", "asked", 5).collect()
            assert {(r["asked"]["q"], r["doc_id"], r["rank"], r["score"]) for r in best} == want and len(best) == 35
    finally:
        sparse.MATRIX_CELLS = cells
