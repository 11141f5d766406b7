"""Notes of a small graph, word by word."""

from pyspark.sql import functions as F

from gleaner.operators import export


def tables(spark):
    rows = [(f"a{i}", f"f{i}", f"x/{i}.py" if i < 4 else None, "1") for i in range(5)] + [(f"b{i}", f"g{i}", f"x/{i}.py", "2") for i in range(5)] + [("c", "[odd|label]#/x", "y:z.py", "3")]
    nodes = spark.createDataFrame([("r", *row, at) for at, row in enumerate(rows)], "repo string, id string, label string, source_file string, community string, ord int")
    edges = spark.createDataFrame([("r", 0, "c", "a0", "calls", 1.0), ("r", 1, "a1", "c", "uses", 1.0)], "repo string, ord int, source string, target string, relation string, weight double")
    odd = spark.createDataFrame([("r", 1, "f0", "g0", "calls", None, ["x/0.py"])], "repo string, surprise_id int, source string, target string, relation string, why string, source_files array<string>")
    return nodes, edges, odd


def test_community_notes(spark):
    nodes, edges, odd = tables(spark)
    summaries = spark.createDataFrame([("r", "1", "runs")], "repo string, community string, summary string")
    got = {r["community"]: r["note"] for r in export.community_notes(nodes, edges, summaries, odd).collect()}
    assert set(got) == {"1", "2"}  # the third has one member
    head = "---\nrepo: r\ncommunity_id: 1\nmembers_count: 5\n---\n\n# Community 1 — r\n\n> [[Overview]] | 5 membros\n\n> [!abstract] Propósito\n> runs\n\n"
    related = "## Comunidades Relacionadas\n\n- [[Community-2]] — 4 ficheiro(s) partilhado(s): `x/0.py`, `x/1.py`, `x/2.py` (+1)\n\n"
    told = "## Conexões Surpreendentes\n\n> [!tip] `f0` → `g0`\n\n"
    members = "## Membros por ficheiro\n\n### `unknown`\n- f4\n\n" + "\n".join(f"### `x/{i}.py`\n- f{i}\n" for i in range(4))
    assert got["1"] == head + related + told + members
    assert export.community_notes(nodes.limit(0), edges.limit(0), summaries, odd).count() == 0


def test_overview_index_and_node_notes(spark):
    nodes, edges, odd = tables(spark)
    repos = spark.createDataFrame([("r", "/s", "/g.json", "now"), ("q", "/t", "/h", "now")], "repo string, source_path string, graph_path string, generated_at string")
    gods = spark.createDataFrame([("r", "c", 2, 1), ("r", "a0", 1, 2)], "repo string, id string, degree int, rank int")
    got = {r["repo"]: r["note"] for r in export.overview_notes(repos, nodes, edges, gods, odd, noted=1).collect()}
    assert got["q"].endswith("> **Nodes:** 0 | **Edges:** 0\n") and "graph_path: /h\n" in got["q"]
    assert "| [[nodes/odd-label/x\\|[odd|label]#/x]] | `y:z.py` | 2 |\n| `f0` | `x/0.py` | 1 |\n\n## Conexões Surpreendentes\n\n### `f0` → `g0`\n**Relação:** calls\n**Ficheiros:** `x/0.py`\n\n## Comunidades\n" in got["r"]
    assert got["r"].endswith("\n\n- [[Community-1]]\n- [[Community-2]]\n")
    index = export.index_note(repos, nodes, edges, gods, "now").collect()
    assert len(index) == 1 and "| [[q/Overview\\|q]] | 0 | 0 | 0 | 0 | `/t` | now |\n| [[r/Overview\\|r]] | 11 | 2 | 2 | 2 | `/s` | now |\n\n## Navegação\n\n- [[q/Overview]]\n- [[r/Overview]]\n" in index[0]["note"]
    located = nodes.withColumn("source_location", F.when(F.col("id") == "c", "L7"))
    notes = {r["id"]: (r["path"], r["note"]) for r in export.node_notes(gods, located, edges).collect()}
    assert notes["c"][0] == "r/nodes/odd-label_x.md" and 'symbol: "[odd|label]#/x"\nsource_file: "y:z.py"\n' in notes["c"][1]
    assert notes["c"][1].endswith("**Ficheiro:** `y:z.py` L7\n\n## Chamadas / Dependências (outgoing)\n\n- `f0` ← calls\n\n## Usado por (incoming)\n\n- `f1` → uses\n") and "`x/0.py` \n" in notes["a0"][1]
