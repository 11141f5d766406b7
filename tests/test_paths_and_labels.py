"""Paths as labels, labels that contain others, and stored indexes of tables that change."""

import random

from pyspark.sql import functions as F

from gleaner.operators import graph
from gleaner.plans import search


def chain(spark, steps):
    """A chain, and a shorter way round with nodes of larger numbers at its end."""
    nodes = [("r", f"n{i}", f"Label{i:04d}.", i) for i in range(steps + 1)] + [("r", "x", "side one", 5000), ("r", "y", "side two", 5001), ("r", "z", "alone", 5002), ("q", "n0", "Label0000.", 0)]
    edges = [("r", i, f"n{i}", f"n{i + 1}") for i in range(steps)] + [("r", 6000, f"n{steps}", "x"), ("r", 6001, "y", f"n{steps}"), ("r", 6002, "y", "x")]
    n = spark.createDataFrame(nodes, "repo string, id string, label string, ord long")
    return n, spark.createDataFrame(edges, "repo string, ord long, source string, target string")


def test_path_over_many_steps(spark):
    nodes, edges = chain(spark, 10)
    asked = spark.createDataFrame([("r", "label0000", "SIDE"), ("r", "side two", "side one"), ("r", "label0003", "label0003"), ("r", "label0001", "alone"), ("r", "nothing", "alone"), ("q", "label0000", "side one")], "repo string, source_label string, target_label string")
    got = {(r["repo"], r["source_label"], r["target_label"]): r["path"] for r in graph.label_paths(edges, nodes, asked).collect()}
    assert got["r", "label0000", "SIDE"] == [f"Label{i:04d}." for i in range(11)] + ["side one"]
    assert got["r", "side two", "side one"] == ["side two", "side one"] and got["r", "label0003", "label0003"] == ["Label0003."]
    assert got["r", "label0001", "alone"] == got["r", "nothing", "alone"] == got["q", "label0000", "side one"] == []


def test_of_equal_paths_the_first_counts(spark):
    nodes = spark.createDataFrame([("r", c, c * 3, i) for i, c in enumerate("abcdef")], "repo string, id string, label string, ord long")
    edges = spark.createDataFrame([("r", i, a, b) for i, (a, b) in enumerate(["ae", "ed", "ac", "df", "cd", "fb", "aa", "ea"])], "repo string, ord long, source string, target string")
    asked = spark.createDataFrame([("r", "aaa", "bbb"), ("r", "bbb", "aaa")], "repo string, source_label string, target_label string")
    got = {r["source_label"]: r["path"] for r in graph.label_paths(edges, nodes, asked).collect()}
    assert got == {"aaa": ["aaa", "ccc", "ddd", "fff", "bbb"], "bbb": ["bbb", "fff", "ddd", "ccc", "aaa"]}


def test_contained_texts_without_a_nested_loop(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    short, long = {word(rng.randint(0, 6)) for _ in range(60)} | {""}, {word(rng.randint(0, 12)) for _ in range(120)}
    df = graph.contained(spark.createDataFrame([(s,) for s in [*short, None]], "short string"), spark.createDataFrame([(s,) for s in [*long, None]], "long string"))
    assert {tuple(r) for r in df.collect()} == {(s, t) for s in short for t in long if s in t}
    nodes = spark.createDataFrame([("r", "1", "Alpha Beta", 1), ("r", "2", "beta", 2), ("s", "3", "gamma()", 3)], "repo string, id string, label string, ord long")
    wanted = spark.createDataFrame([("BETA",), ("the gamma() of all",), ("delta",)], "wanted string")
    found = graph.find_by_label(nodes, wanted)
    assert {r["wanted"]: r["id"] for r in found.collect()} == {"BETA": "1", "the gamma() of all": "3"}
    looped = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastNestedLoopJoin" in line or "CartesianProduct" in line]
    assert len(looped) <= 2 * 2  # the empty text alone, on each side (told twice by an adaptive plan)


def test_index_follows_its_table(spark, tmp_path):
    """A table that is written anew under the same path is indexed anew."""
    path, terms = str(tmp_path / "documents.parquet"), lambda: {r["term"] for r in search.bm25_vocab(spark, str(tmp_path)).collect()}
    spark.createDataFrame([(1, "red boat")], "doc_id long, text string").write.parquet(path)
    assert terms() == {"red", "boat"}
    kept = dict(search._STORED)
    assert terms() == {"red", "boat"} and search._STORED == kept
    spark.createDataFrame([(1, "red boat"), (2, "green tree")], "doc_id long, text string").write.mode("overwrite").parquet(path)
    assert terms() == {"red", "boat", "green", "tree"}


def test_no_join_pairs_all_passages(spark, sf_dir):
    """Only the first passages of a question reach what follows the search."""
    asked = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(F.col("vec_id") % search.QUERY_STEP == 0).count()
    assert search.passages(spark, sf_dir).count() == asked * search.FETCHED


def test_nodes_are_not_broadcast_by_the_size_of_their_file(spark, sf_dir):
    """A small file of parts may be millions of nodes: joins on them deal both sides out."""
    from gleaner.plans import graphs

    for name in ("community_edges", "top_edges"):
        plan = getattr(graphs, name)(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("ShuffledHashJoin") == 4 and plan.count("BroadcastHashJoin") <= 1  # of lines alone, by their size


def test_a_search_is_made_once_for_questions_of_the_same_nodes(spark, monkeypatch):
    """However many questions name two nodes, their frontiers are grown once; many rows give what few give."""
    nodes, edges = chain(spark, 4)
    grown, sizes = graph._grown, []
    monkeypatch.setattr(graph, "_grown", lambda frontier, *rest: (sizes.append(frontier.count()), grown(frontier, *rest))[1])
    asked = [("r", a, b) for a in ("label0000", "LABEL0000", "Label0000.", "el0000") for b in ("label0003", "LABEL0003", "abel0003.")]
    for few in (getattr(graph, "FEW_ROWS", 0), 0):
        monkeypatch.setattr(graph, "FEW_ROWS", few, raising=False)
        got = graph.label_paths(edges, nodes, spark.createDataFrame(asked, "repo string, source_label string, target_label string")).collect()
        assert len(got) == 12 and {tuple(r["path"]) for r in got} == {tuple(f"Label{i:04d}." for i in range(4))}
        assert max(sizes) == 1 and len(sizes) == 3
        sizes.clear()
