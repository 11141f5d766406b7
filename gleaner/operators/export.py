"""Knowledge graphs as Markdown notes, and sinks of notes, metrics and traces."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gleaner.operators.graph import both_ways, community_surprises, community_tags, cross_links, diagrams, keyed, labelled, large_communities
from gleaner.operators.ranking import top_k


# The characters for which front matter quotes a string, and the words and marks of the notes below.
QUOTED_FOR = ":#[]{},&*?|-<>=!%@`"


def front(value: Column) -> Column:
    """A string in front matter: in double quotes if it has a character that needs them."""
    return F.when(F.translate(value, QUOTED_FOR, "") != value, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)


def link_name(label: Column) -> Column:
    """A label as wiki links can name it."""
    return F.translate(label, "|[]#", "-")


def file_name(label: Column) -> Column:
    return F.translate(link_name(label), "/\\", "__")


def lines_of(rows: DataFrame, by: list[str], order: Column, line: Column, name: str, between: str = "\n") -> DataFrame:
    """The lines of each group, joined in order: ``name``."""
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("t"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["t"]), between).alias(name))


def _listed(near: DataFrame, direction: str, title: str, arrow: str) -> DataFrame:
    """The lines of one section of each node's note."""
    line = F.concat(F.lit("- `"), "neighbor_label", F.lit(f"` {arrow} "), "relation")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n")
    return near.filter(F.col("direction") == direction).groupBy("repo", "id").agg(F.concat(F.lit(f"## {title}\n\n"), lines, F.lit("\n")).alias(direction))


def node_notes(gods: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 15) -> DataFrame:
    """``repo, id, path, note``: a note for each of the best connected nodes (``repo, id, degree``) with its first ``k``
    neighbours each way in edge order."""
    located = nodes if "source_location" in nodes.columns else nodes.withColumn("source_location", F.lit(""))
    told = gods.select("repo", "id", "degree").join(keyed(located.select("repo", "id", "label", "source_file", "source_location", "community")), ["repo", "id"])
    ends = both_ways(edges).join(told.select("repo", "id"), ["repo", "id"])
    near = labelled(top_k(ends, ["repo", "id", "direction"], k, F.col("ord"), F.col("neighbor")), nodes, "neighbor", "neighbor_label")
    rows = told.join(_listed(near, "outgoing", "Chamadas / Dependências (outgoing)", "←"), ["repo", "id"], "left").join(_listed(near, "incoming", "Usado por (incoming)", "→"), ["repo", "id"], "left")
    head = F.concat(
        F.lit("---\nrepo: "), "repo", F.lit("\nsymbol: "), front(F.col("label")), F.lit("\nsource_file: "), front(F.col("source_file")), F.lit("\ndegree: "), F.col("degree").cast("string"),
        F.lit("\ncommunity: "), "community", F.lit("\ntags: [god-node]\n---\n\n# `"), "label", F.lit("`\n\n> [[../Overview]] | [[../Community-"), "community", F.lit("]] | Degree: "),
        F.col("degree").cast("string"), F.lit("\n\n**Ficheiro:** `"), "source_file", F.lit("` "), F.coalesce("source_location", F.lit("")), F.lit("\n"),
    )
    path = F.concat("repo", F.lit("/nodes/"), file_name(F.col("label")), F.lit(".md"))
    return rows.select("repo", "id", path.alias("path"), F.concat_ws("\n", head, "outgoing", "incoming").alias("note"))


def _code(name: Column) -> Column:
    return F.concat(F.lit("`"), name, F.lit("`"))


def community_notes(nodes: DataFrame, edges: DataFrame, summaries: DataFrame, surprises: DataFrame, links: int = 5, files: int = 3) -> DataFrame:
    """``repo, community, path, note``: a note for each large community.

    Its tags, summary (``repo, community, summary``), call diagram, the ``links`` communities that share most files with
    it (the first ``files`` of them told), the surprises (``repo, surprise_id, source, target, why, source_files``) in its
    files, and its members by file. Parts that it doesn't have are left out; nodes without a file are under "unknown". A
    note is one text, and so one row.
    """
    by = ["repo", "community"]
    large = large_communities(nodes)
    tags = community_tags(nodes).filter(F.size("tags") > 0).select(*by, F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]\n")).alias("tags"))
    about = summaries.filter("summary <> ''").select(*by, F.concat(F.lit("> [!abstract] Propósito\n> "), "summary", F.lit("\n\n")).alias("about"))
    drawn = diagrams(edges, nodes).select(*by, F.concat(F.lit("## Fluxo de Chamadas\n\n```mermaid\n"), "diagram", F.lit("\n```\n\n")).alias("drawn"))
    near = top_k(cross_links(nodes), by, links, F.desc("shared_count"), F.col("other").cast("long"), F.col("other"))
    more = F.when(F.col("shared_count") > files, F.concat(F.lit(" (+"), (F.col("shared_count") - files).cast("string"), F.lit(")"))).otherwise("")
    shared = F.array_join(F.transform(F.slice("shared_files", 1, files), _code), ", ")
    line = F.concat(F.lit("- [[Community-"), "other", F.lit("]] — "), F.col("shared_count").cast("string"), F.lit(" ficheiro(s) partilhado(s): "), shared, more)
    related = lines_of(near, by, F.col("rank"), line, "t").select(*by, F.concat(F.lit("## Comunidades Relacionadas\n\n"), "t", F.lit("\n\n")).alias("related"))
    met = community_surprises(surprises, nodes).join(surprises.select("repo", "surprise_id", "source", "target", "why"), ["repo", "surprise_id"])
    why = F.when(F.coalesce("why", F.lit("")) == "", "").otherwise(F.concat(F.lit("> "), "why", F.lit("\n")))
    tip = F.concat(F.lit("> [!tip] "), _code(F.col("source")), F.lit(" → "), _code(F.col("target")), F.lit("\n"), why)
    odd = lines_of(met, by, F.col("surprise_id"), tip, "t").select(*by, F.concat(F.lit("## Conexões Surpreendentes\n\n"), "t", F.lit("\n")).alias("odd"))
    file = F.when(F.coalesce("source_file", F.lit("")) == "", "unknown").otherwise(F.col("source_file"))
    members = nodes.select(*by, file.alias("file"), F.coalesce("label", "id").alias("label")).join(large.select(*by), by)
    listed = lines_of(members, [*by, "file"], F.col("label"), F.concat(F.lit("- "), "label"), "t")
    parts = lines_of(listed, by, F.col("file"), F.concat(F.lit("### "), _code(F.col("file")), F.lit("\n"), "t", F.lit("\n")), "members_text")
    rows = large
    for part in (tags, about, drawn, related, odd, parts):
        rows = rows.join(part, by, "left")
    count = F.col("members").cast("string")
    note = F.concat(
        F.lit("---\nrepo: "), "repo", F.lit("\ncommunity_id: "), "community", F.lit("\nmembers_count: "), count, F.lit("\n"), F.coalesce("tags", F.lit("")), F.lit("---\n\n# Community "), "community", F.lit(" — "), "repo",
        F.lit("\n\n> [[Overview]] | "), count, F.lit(" membros\n\n"), *(F.coalesce(c, F.lit("")) for c in ("about", "drawn", "related", "odd")), F.lit("## Membros por ficheiro\n\n"), F.coalesce("members_text", F.lit("")),
    )
    return rows.select("repo", "community", F.concat("repo", F.lit("/Community-"), "community", F.lit(".md")).alias("path"), note.alias("note"))


def overview_notes(repos: DataFrame, nodes: DataFrame, edges: DataFrame, gods: DataFrame, surprises: DataFrame, noted: int = 10) -> DataFrame:
    """``repo, path, note``: the overview of each repository (``repo, source_path, graph_path, generated_at``).

    How many nodes, edges and large communities it has; its best connected nodes (``repo, id, degree, rank``), the first
    ``noted`` as links to their notes; the surprises (``repo, surprise_id, source, target, relation, why, source_files``);
    links to its large communities in the order of their numbers.
    """
    counts = graph_counts(nodes, edges)
    told = gods.select("repo", "id", "degree", "rank").join(keyed(nodes.select("repo", "id", "label", "source_file")), ["repo", "id"], "left").withColumn("label", F.coalesce("label", "id"))
    name = F.when(F.col("rank") <= noted, F.concat(F.lit("[[nodes/"), link_name(F.col("label")), F.lit("\\|"), "label", F.lit("]]"))).otherwise(_code(F.col("label")))
    row = F.concat(F.lit("| "), name, F.lit(" | "), _code(F.coalesce("source_file", F.lit(""))), F.lit(" | "), F.col("degree").cast("string"), F.lit(" |"))
    best = lines_of(told, ["repo"], F.col("rank"), row, "t").select("repo", F.concat(F.lit("## God Nodes\n\n> Nós mais conectados — prováveis pontos de entrada no código\n\n| Símbolo | Ficheiro | Degree |\n|---------|----------|--------|\n"), "t", F.lit("\n\n")).alias("best"))
    paths = F.when(F.size("source_files") > 0, F.concat(F.lit("**Ficheiros:** "), F.array_join(F.transform("source_files", _code), ", "), F.lit("\n"))).otherwise("")
    why = F.when(F.coalesce("why", F.lit("")) == "", "").otherwise(F.concat(F.lit("**Porquê:** "), "why", F.lit("\n")))
    entry = F.concat(F.lit("### "), _code(F.col("source")), F.lit(" → "), _code(F.col("target")), F.lit("\n**Relação:** "), "relation", F.lit("\n"), F.coalesce(paths, F.lit("")), why)
    odd = lines_of(surprises, ["repo"], F.col("surprise_id"), entry, "t").select("repo", F.concat(F.lit("## Conexões Surpreendentes\n\n"), "t", F.lit("\n")).alias("odd"))
    order = F.struct(F.col("community").cast("long"), F.col("community"))
    index = lines_of(large_communities(nodes), ["repo"], order, F.concat(F.lit("- [[Community-"), "community", F.lit("]]")), "t").select("repo", F.concat(F.lit("## Comunidades\n\n> Grupos de módulos fortemente relacionados (só comunidades com ≥ 5 membros)\n\n"), "t", F.lit("\n")).alias("index"))
    rows = repos.select("repo", "source_path", "graph_path", "generated_at").join(counts, "repo", "left").fillna(0, ["nodes", "edges", "communities"])
    for part in (best, odd, index):
        rows = rows.join(part, "repo", "left")
    n = lambda c: F.col(c).cast("string")
    note = F.concat(
        F.lit("---\nrepo: "), "repo", F.lit("\nsource_path: "), front(F.col("source_path")), F.lit("\ngraph_path: "), front(F.col("graph_path")), F.lit("\ngenerated_at: "), "generated_at", F.lit("\nnodes: "), n("nodes"),
        F.lit("\nedges: "), n("edges"), F.lit("\ncommunities: "), n("communities"), F.lit("\n---\n\n# "), "repo", F.lit(" — Knowledge Graph\n\n> [!info] Projecto fonte\n> **Path:** "), _code(F.col("source_path")), F.lit("\n> **Grafo:** "),
        _code(F.col("graph_path")), F.lit("\n> **Gerado:** "), "generated_at", F.lit("\n> **Nodes:** "), n("nodes"), F.lit(" | **Edges:** "), n("edges"), F.lit("\n\n"), *(F.coalesce(c, F.lit("")) for c in ("best", "odd", "index")),
    )
    return rows.select("repo", F.concat("repo", F.lit("/Overview.md")).alias("path"), F.concat(F.rtrim(note, F.lit("\n")), F.lit("\n")).alias("note"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo, nodes, edges, communities`` (large ones) of each repository with nodes."""
    large = large_communities(nodes).groupBy("repo").agg(F.count(F.lit(1)).alias("communities"))
    rows = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("nodes")).join(edges.groupBy("repo").agg(F.count(F.lit(1)).alias("edges")), "repo", "left").join(large, "repo", "left")
    return rows.fillna(0, ["edges", "communities"])


def index_note(repos: DataFrame, nodes: DataFrame, edges: DataFrame, gods: DataFrame, generated_at: str, noted: int = 10) -> DataFrame:
    """``path, note``: one note with a line and a link for each repository (``repo, source_path, generated_at``), in the
    order of names; the rows that meet in it are as many as there are repositories."""
    best = gods.filter(F.col("rank") <= noted).groupBy("repo").agg(F.count(F.lit(1)).alias("gods"))
    rows = repos.select("repo", "source_path", "generated_at").join(graph_counts(nodes, edges), "repo", "left").join(best, "repo", "left").fillna(0, ["nodes", "edges", "communities", "gods"])
    n = lambda c: F.col(c).cast("string")
    row = F.concat(F.lit("| [["), "repo", F.lit("/Overview\\|"), "repo", F.lit("]] | "), n("nodes"), F.lit(" | "), n("edges"), F.lit(" | "), n("communities"), F.lit(" | "), n("gods"), F.lit(" | "), _code(F.col("source_path")), F.lit(" | "), "generated_at", F.lit(" |"))
    link = F.concat(F.lit("- [["), "repo", F.lit("/Overview]]"))
    listed = F.array_sort(F.collect_list(F.struct("repo", row.alias("row"), link.alias("link"))))
    told = rows.agg(listed.alias("l"), F.count(F.lit(1)).cast("string").alias("repos"))
    joined = lambda c: F.array_join(F.transform("l", lambda x: F.concat(x[c], F.lit("\n"))), "")
    note = F.concat(
        F.lit(f"---\ngenerated_at: {generated_at}\nrepos_count: "), "repos", F.lit("\ntags: [knowledge-graph, rag, index]\n---\n\n# Knowledge Graphs — Índice\n\n> Gerado em "), F.lit(generated_at),
        F.lit("\n> Vault dedicado à visualização estrutural de repositórios de código.\n\n## Repositórios\n\n| Repo | Nodes | Edges | Comunidades | God Nodes | Fonte | Actualizado |\n|------|-------|-------|-------------|-----------|-------|-------------|\n"),
        joined("row"), F.lit("\n## Navegação\n\n"), joined("link"),
    )
    return told.select(F.lit("index.md").alias("path"), note.alias("note"))


def write_notes(notes: DataFrame, folder: str) -> None:
    """Write each note to its path under ``folder``, which all tasks can reach; a note that is written again is the same."""

    def write(rows: Iterator[Row]) -> None:
        from pathlib import Path

        for row in rows:
            target = Path(folder) / row["path"]
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(row["note"], encoding="utf-8")

    notes.select("path", "note").foreachPartition(write)


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON document a row, as logs, traces and metrics are written: ``write.mode("append").text``."""
    return rows.select(F.to_json(F.struct(*(F.col(c) for c in rows.columns))).alias("value"))
