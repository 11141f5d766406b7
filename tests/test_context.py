"""The context of questions: routes, gates, budgets and blocks on small tables."""

from pyspark.sql import functions as F

from gleaner.operators import context


def test_first_lines(spark):
    rows = spark.createDataFrame([("one two\n\nthree four\nfive", n) for n in (0, 3, 4, 6, 100)] + [("", 0)], "t string, n int")
    got = {(r["t"], r["n"]): r["x"] for r in rows.withColumn("x", context.first_lines(F.col("t"), F.col("n"))).collect()}
    text = "one two\n\nthree four\nfive"
    # Lines count 2, 1 (a line end), 2 and 1 tokens; the first one stays whatever the budget is.
    assert [got[text, n] for n in (0, 3, 4, 6, 100)] == ["one two", "one two", "one two", text, text] and got["", 0] == ""


def test_routes(spark):
    asked = spark.createDataFrame([(1, "", "none"), (2, "", "rag_only"), (3, "", "graph_only"), (4, "", "both"), (5, "what is a prime?", "auto"), (6, None, None)], "query_id int, text string, setting string")
    got = {r["query_id"]: (r["mode"], r["use_notes"], r["use_code"], r["use_graph"]) for r in context.routed(asked).collect()}
    assert got[1] == got[5] == ("NO_CONTEXT", False, False, False) and got[2] == ("RAG_ONLY", True, True, False)
    assert got[3] == ("GRAPH_ONLY", False, False, True) and got[4] == ("RAG_AND_GRAPH", True, True, True) and not any(got[6][1:])


def test_assembled(spark):
    routes = spark.createDataFrame([(i, "RAG_AND_GRAPH") for i in range(1, 6)], "query_id int, mode string")
    notes = spark.createDataFrame([(1, 1, 0.625, "T", "S", "a note"), (1, 2, 0.5, "U", None, "word " * 50), (2, 1, 0.4, "T", "", "weak"), (5, 1, 0.9, "N", "", None)], "query_id int, rank int, score double, title string, section string, text string")
    code = spark.createDataFrame([(1, 2, 0.6, "r2", "b.py", "g", "y"), (1, 1, 0.7, "r1", "a.py", "f", "x"), (1, 3, 0.5, "r1", "c.py", "", "z")], "query_id int, rank int, score double, repo string, source_path string, section string, text string")
    graphs = spark.createDataFrame([(1, "[g]\nline\n[/g]"), (3, "alone")], "query_id int, graph string")
    got = {r["query_id"]: r for r in context.assembled(routes, notes, code, graphs, total=50).collect()}
    assert len(got) == 5 and {i: got[i]["sources"] for i in got} == {1: "graph+rag", 2: "none", 3: "graph", 4: "none", 5: "rag"}
    assert [got[i]["context"] for i in (2, 4)] == ["", ""] and got[3]["context"].startswith("alone\n\n")
    first = got[1]["context"]
    # The second note is beyond 20 of 50 tokens; halves of scores go to the even digit; r1 comes first and once.
    assert first.startswith("[CONTEXTO DAS NOTAS PESSOAIS]\n[T / S]  score=0.62\na note\n\n[/CONTEXTO DAS NOTAS]\n\n[CONTEXTO DO CÓDIGO — r1]\n[a.py / f]  score=0.70\nx\n\n[c.py]  score=0.50\nz\n\n[/CONTEXTO DO CÓDIGO — r1]\n\n[CONTEXTO DO CÓDIGO — r2]")
    assert "word" not in first and "[g]" in first and got[5]["context"].startswith("[CONTEXTO DAS NOTAS PESSOAIS]\n[N]  score=0.90\n\n\n[/")
    empty = context.assembled(routes.limit(0), notes.limit(0), code.limit(0), graphs.limit(0))
    assert empty.count() == 0
