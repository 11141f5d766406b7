"""Knowledge graphs as node and edge tables.

Nodes: ``repo, id, label, source_file, community`` and ``ord`` (their order). Edges: ``repo, ord, source, target,
relation, weight``. Labels fall back to ids where an end has no node.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import lexicons
from gleaner.functions.text import diagram_id, estimated_tokens, normal_label
from gleaner.operators.ordering import checkpointed, stored, with_row_number
from gleaner.operators.ranking import ranked, top_k

LEAST_MEMBERS = 5
#: Of paths that end with one another so many last characters at most are the key of their join.
PATH_TAIL = 24
#: Characters of the grams by which labels are looked up in others.
GRAM = 4
#: A side of a join with at most so many rows is sent to where the other lies (frontiers to the links).
FEW_ROWS = 200_000


def keyed(nodes: DataFrame) -> DataFrame:
    """A side of a join with a row for each node. It is dealt out with the other side: by the size of a well compressed
    file Spark would broadcast millions of nodes, and hold them in the driver and in each task once a join."""
    return nodes.hint("shuffle_hash")


def labelled(edges: DataFrame, nodes: DataFrame, end: str, name: str) -> DataFrame:
    """Add the label of one end of each edge."""
    names = nodes.select(F.col("repo"), F.col("id").alias(end), F.col("label").alias("__label"))
    return edges.join(keyed(names), ["repo", end], "left").withColumn(name, F.coalesce("__label", end)).drop("__label")


def large_communities(nodes: DataFrame, least: int = LEAST_MEMBERS) -> DataFrame:
    return nodes.groupBy("repo", "community").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= least)


def internal_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are in the same community, with it."""
    side = lambda end: nodes.select("repo", F.col("id").alias(end), F.col("community").alias(f"{end}_community"))
    joined = edges.join(keyed(side("source")), ["repo", "source"]).join(keyed(side("target")), ["repo", "target"])
    return joined.filter("source_community = target_community").withColumnRenamed("source_community", "community").drop("target_community")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``repo, id, community, degree``: ends of edges at each node."""
    ends = edges.select("repo", F.col("source").alias("id")).unionByName(edges.select("repo", F.col("target").alias("id")))
    counted = ends.groupBy("repo", "id").agg(F.count(F.lit(1)).alias("degree"))
    return keyed(nodes.select("repo", "id", "community")).join(counted, ["repo", "id"])


def both_ways(edges: DataFrame) -> DataFrame:
    """``repo, id, neighbor, relation, direction, ord, weight``: a self-loop is outgoing."""
    out = edges.select("repo", F.col("source").alias("id"), F.col("target").alias("neighbor"), "relation", F.lit("outgoing").alias("direction"), "ord", "weight")
    into = edges.filter("source <> target").select("repo", F.col("target").alias("id"), F.col("source").alias("neighbor"), "relation", F.lit("incoming").alias("direction"), "ord", "weight")
    return out.unionByName(into)


def neighbors(edges: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """The first k neighbours of every node in edge order, each once, by its first edge."""
    first = both_ways(edges).groupBy("repo", "id", "neighbor").agg(F.min_by(F.struct("relation", "direction"), "ord").alias("e"), F.min("ord").alias("ord"))
    kept = top_k(first.select("repo", "id", "neighbor", "ord", "e.*"), ["repo", "id"], k, F.col("ord"), F.col("neighbor"))
    return labelled(kept, nodes, "neighbor", "neighbor_label")


def _grams(text: Column, size: int) -> Column:
    """The different runs of ``size`` characters of a text that has so many."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """``short, long``: the different texts of both (one column each, of that name) of which the second contains the first.

    An equality join on grams: what contains a text has all its grams of ``GRAM`` characters, so the text is looked up by
    the one that fewest of the others have. Texts that are shorter are a gram themselves; the empty text is in all.
    """
    short, long = short.filter("short is not null").distinct(), long.filter("long is not null").distinct()
    sizes = [r["n"] for r in short.select(F.least(F.length("short"), F.lit(GRAM)).alias("n")).filter("n > 0").distinct().collect()]  # GRAM numbers at most
    every = F.concat(*(_grams(F.col("long"), n) for n in sorted(sizes))) if sizes else F.array().cast("array<string>")
    index = checkpointed(long.select("long", F.explode(every).alias("gram")))
    common = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("short") < GRAM, F.array("short")).otherwise(_grams(F.col("short"), GRAM))
    keys = short.filter("short <> ''").select("short", F.explode(own).alias("gram")).join(common, "gram", "left")
    # A gram that no other text has rules the text out, and is the rarest.
    rarest = keys.groupBy("short").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    met = rarest.join(index, "gram").filter(F.contains("long", F.col("short"))).select("short", "long")
    return met.unionByName(long.crossJoin(F.broadcast(short.filter("short = ''"))).select("short", "long"))


def find_by_label(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted, repo, id``: the first node whose label contains the wanted one or lies in it, case aside."""
    first = F.min(F.struct("ord", "id", "repo"))
    labels = checkpointed(nodes.groupBy(F.lower("label").alias("low")).agg(first.alias("n")))
    asked = wanted.select("wanted", F.lower("wanted").alias("asked")).distinct()
    lows, asks = labels.select("low"), asked.select("asked")
    inside = contained(asks.toDF("short"), lows.toDF("long")).select(F.col("short").alias("asked"), F.col("long").alias("low"))
    around = contained(lows.toDF("short"), asks.toDF("long")).select(F.col("long").alias("asked"), F.col("short").alias("low"))
    best = inside.unionByName(around).join(labels, "low").groupBy("asked").agg(F.min("n").alias("n"))
    return asked.join(best, "asked").select("wanted", "n.repo", "n.id")


def find_in_repo(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``repo, wanted, id, ord``: the first node of the repository (of ``repo, wanted``) whose label contains the wanted
    one, case aside."""
    labels = nodes.groupBy("repo", F.lower("label").alias("low")).agg(F.min(F.struct("ord", "id")).alias("n"))
    asked = wanted.select("repo", "wanted", F.lower("wanted").alias("asked")).distinct()
    pairs = contained(asked.select(F.col("asked").alias("short")), labels.select(F.col("low").alias("long")))
    met = asked.join(pairs, F.col("asked") == F.col("short")).join(labels, (asked["repo"] == labels["repo"]) & (F.col("long") == F.col("low")))
    return met.groupBy(asked["repo"], "wanted").agg(F.min("n").alias("n")).select("repo", "wanted", "n.id", "n.ord")


def cross_links(nodes: DataFrame) -> DataFrame:
    """Pairs of large communities that share files, in both directions, with the files in order."""
    files = nodes.filter("source_file <> ''").join(large_communities(nodes).select("repo", "community"), ["repo", "community"]).select("repo", "community", "source_file").distinct()
    other = files.select("repo", "source_file", F.col("community").alias("other"))
    pairs = files.join(other, ["repo", "source_file"]).filter("community <> other")
    return pairs.groupBy("repo", "community", "other").agg(F.array_sort(F.collect_set("source_file")).alias("shared_files")).withColumn("shared_count", F.size("shared_files"))


def community_files(nodes: DataFrame, files: int = 10, symbols: int = 5) -> DataFrame:
    """The files with most symbols of each large community and their first symbols."""
    kept = nodes.filter("source_file <> ''").join(large_communities(nodes).select("repo", "community"), ["repo", "community"])
    counted = kept.groupBy("repo", "community", "source_file").agg(F.count(F.lit(1)).alias("symbols"), F.min("ord").alias("ord"))
    best = top_k(counted, ["repo", "community"], files, F.desc("symbols"), F.col("ord"))
    named = top_k(kept.select("repo", "community", "source_file", "label", F.col("ord").alias("symbol_ord")), ["repo", "community", "source_file"], symbols, F.col("symbol_ord"))
    listed = named.groupBy("repo", "community", "source_file").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("first"))
    more = F.when(F.col("symbols") > symbols, F.concat(F.lit(" (+"), (F.col("symbols") - symbols).cast("string"), F.lit(")"))).otherwise("")
    text = F.concat(F.array_join(F.transform("first", lambda x: x["label"]), ", "), more)
    return best.join(listed, ["repo", "community", "source_file"]).select("repo", "community", "source_file", "symbols", "rank", text.alias("listed"))


def community_tags(nodes: DataFrame) -> DataFrame:
    """The tags that the paths of a large community's files give it, in order."""
    tags = F.array(*(F.when(F.contains("source_file", F.lit(p)), F.lit(t)) for p, t in lexicons.PATH_TAGS))
    found = nodes.select("repo", "community", F.explode(F.array_compact(tags)).alias("tag")).distinct()
    listed = found.groupBy("repo", "community").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return large_communities(nodes).select("repo", "community").join(listed, ["repo", "community"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def community_surprises(surprises: DataFrame, nodes: DataFrame) -> DataFrame:
    """Surprises (``surprise_id, source_files``) of each community that has one of their files."""
    files = nodes.select("repo", "community", "source_file").distinct()
    told = surprises.select("repo", "surprise_id", F.explode("source_files").alias("source_file"))
    return told.join(files, ["repo", "source_file"]).select("repo", "community", "surprise_id").distinct()


def top_edges(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The heaviest edges inside each community, earlier ones first of equals."""
    return top_k(internal_edges(edges, nodes), ["repo", "community"], k, F.desc("weight"), F.col("ord"))


def diagrams(edges: DataFrame, nodes: DataFrame, most: int = 12, least: int = 3) -> DataFrame:
    """A flow diagram of each community with at least three edges worth telling."""
    told = internal_edges(edges.filter(F.col("relation").isin(*lexicons.TOLD_RELATIONS)), nodes)
    enough = told.groupBy("repo", "community").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")
    best = top_k(told.join(enough, ["repo", "community"]), ["repo", "community"], most, F.desc("weight"), F.col("ord"))
    named = labelled(labelled(best, nodes, "source", "a"), nodes, "target", "b")
    box = lambda c: F.concat(diagram_id(F.col(c)), F.lit('["'), F.col(c), F.lit('"]'))
    arrow = F.when(F.col("relation") == "calls", " --> ").otherwise(F.concat(F.lit(" --"), F.col("relation"), F.lit("--> ")))
    lines = named.withColumn("line", F.concat(F.lit("    "), box("a"), arrow, box("b"))).groupBy("repo", "community").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return lines.select("repo", "community", F.concat(F.lit("graph LR\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("diagram"))


def match_chunks(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node of each chunk (``chunk_id, repo, source_path, section_header``) and the tier of the match.

    1: same file and label. 2: same label, one path ends with the other. 3: such paths, and one label lies in the other.
    Within a tier the first node wins; of nodes with the same file and label the last one counts. The equi-join on
    labels serves the first two tiers; only chunks without a match there are joined by the ends of paths.
    """
    index = nodes.filter("source_file <> '' and label <> ''").withColumn("norm", normal_label(F.col("label")))
    index = index.groupBy("repo", "source_file", "norm").agg(F.max_by("id", "ord").alias("id"), F.min("ord").alias("ord"))
    asked = chunks.withColumn("asked", normal_label(F.col("section_header")))
    ends = F.endswith(F.col("source_path"), F.col("source_file")) | F.endswith(F.col("source_file"), F.col("source_path"))
    by_label = asked.join(index, (asked["repo"] == index["repo"]) & (F.col("asked") == F.col("norm"))).drop(index["repo"]).filter(ends)
    tier = F.when(F.col("source_path") == F.col("source_file"), 1).otherwise(2)
    first = by_label.withColumn("tier", tier).groupBy("chunk_id").agg(F.min_by(F.struct("id", "tier"), F.struct("tier", "ord")).alias("m"))
    left = asked.join(first.select("chunk_id"), "chunk_id", "left_anti")
    inside = F.contains(F.col("norm"), F.col("asked")) | F.contains(F.col("asked"), F.col("norm"))
    # Paths that end with one another end in the same characters: those of the shorter one, so its last ones are the key.
    short = checkpointed(index.groupBy(F.least(F.length("source_file"), F.lit(PATH_TAIL)).alias("n")).count())
    sizes = [r["n"] for r in short.select("n").union(left.select(F.least(F.length("source_path"), F.lit(PATH_TAIL)))).distinct().collect()]  # PATH_TAIL numbers at most
    lengths = F.array(*(F.lit(n) for n in sorted(sizes))) if sizes else F.array().cast("array<int>")
    keyed = lambda df, column: df.withColumn("n", F.explode(F.filter(lengths, lambda n: n <= F.length(column)))).withColumn("tail", F.expr(f"substring({column}, -n, n)"))
    least = F.least(F.length("source_file"), F.length("source_path"), F.lit(PATH_TAIL))
    asked_keys, index_keys = keyed(left, "source_path"), keyed(index, "source_file").withColumnRenamed("repo", "__repo").withColumnRenamed("n", "__n").withColumnRenamed("tail", "__tail")
    met = asked_keys.join(index_keys, (F.col("repo") == F.col("__repo")) & (F.col("n") == F.col("__n")) & (F.col("tail") == F.col("__tail")) & (F.col("n") == least) & ends & inside)
    by_path = met.groupBy("chunk_id").agg(F.min_by("id", F.col("ord")).alias("id"))
    return first.select("chunk_id", "m.id", "m.tier").unionByName(by_path.select("chunk_id", "id", F.lit(3).alias("tier")))


def _links(edges: DataFrame) -> DataFrame:
    """``repo, id, next``: both ways along each edge, each once. The edges are made once, not once a way."""
    ways = F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("next")), F.struct(F.col("target").alias("id"), F.col("source").alias("next"))))
    return edges.select("repo", ways.alias("w")).select("repo", "w.id", "w.next").distinct()


def _beside(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join with so many rows: few are sent to where the other side lies, more are dealt out with it."""
    return F.broadcast(df) if rows <= FEW_ROWS else df.hint("merge")


def shortest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, id, steps``: the length of the shortest path, either way along edges, from each start to what it reaches.

    Each round joins the last frontier with the edges. A neighbour of a frontier is in it, in the one before or in the
    next one, so these two are all that is left out, and each frontier is written once.
    """
    links = stored(_links(edges).select("id", "next").distinct())
    frontier = stored(starts.select("start", F.col("start").alias("id"), F.lit(0).alias("steps")).distinct())
    levels = [frontier]
    while rows := frontier.count():
        grown = links.join(_beside(frontier, rows), "id").select("start", F.col("next").alias("id")).distinct()
        seen = frontier.unionByName(levels[-2]) if len(levels) > 1 else frontier
        frontier = stored(grown.join(seen.hint("merge"), ["start", "id"], "left_anti").withColumn("steps", F.lit(len(levels))))
        levels.append(frontier)
    return functools.reduce(DataFrame.unionByName, levels)


def _grown(frontier: DataFrame, rows: int, before: DataFrame, links: DataFrame, ahead: bool) -> DataFrame:
    """The next frontier: to each new node the smallest of the paths that lead there."""
    more = links.join(_beside(frontier, rows), "at")
    path = F.concat("path", F.array("next")) if ahead else F.concat(F.array("next"), "path")
    # What was reached before has no path here, so one aggregate finds the smallest paths and leaves it out.
    seen = frontier.unionByName(before).withColumn("path", F.lit(None).cast("array<long>"))
    told = more.select("start", F.col("next").alias("at"), path.alias("path")).unionByName(seen)
    grown = told.groupBy("start", "at").agg(F.min("path").alias("path"), F.count_if(F.col("path").isNull()).alias("known"))
    return stored(grown.filter("known = 0").drop("known"))


def paths_between(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """``source, target, path``: the smallest of the shortest paths along ``links`` (``at, next``, both ways) between the
    nodes of each pair, numbers all; pairs without one are left out.

    Frontiers grow by turns from all sources and all targets, each node with the smallest path to it, until a pair's meet.
    A frontier is grown once however many pairs begin or end at its node; it leaves when all of them have met or can't.
    """
    ends, names = ("source", "target"), ("path", "rest")
    live = stored(pairs.select(*ends).distinct())
    left = live.count()
    sides = [stored(live.select(F.col(e).alias("start"), F.col(e).alias("at"), F.array(e).alias("path")).distinct()) for e in ends]
    before, rows = [s.limit(0) for s in sides], [s.count() for s in sides]
    done, turn = [], 1
    while True:
        # Pairs are brought to the smaller side; the meeting node ends one path and begins the other.
        least = 0 if rows[0] <= rows[1] else 1
        tell = [s.select(F.col("start").alias(e), "at", F.col("path").alias(n)) for s, e, n in zip(sides, ends, names, strict=True)]
        near = tell[least].join(_beside(live, left), ends[least]).hint("merge" if rows[least] > FEW_ROWS else "shuffle_hash")
        both = tell[1 - least].join(near, [ends[1 - least], "at"])
        met = both.groupBy(*ends).agg(F.min(F.concat("path", F.expr("slice(rest, 2, size(rest))"))).alias("path"))
        # Only the side that grew last can have lost starts.
        grew = sides[turn].select(F.col("start").alias(ends[turn])).distinct().hint("merge")
        state = stored(live.join(grew, ends[turn], "left_semi").join(met.hint("merge"), [*ends], "left"))
        done.append(state.filter("path is not null"))
        live = state.filter("path is null").select(*ends)
        if not (left := live.count()):
            return functools.reduce(DataFrame.unionByName, done)
        turn = 1 - turn
        kept = lambda s, e=ends[turn]: s.join(_beside(live.select(F.col(e).alias("start")).distinct(), left), "start", "left_semi").select("start", "at", "path")  # noqa: B023, E731
        last = kept(sides[turn])
        sides[turn], before[turn] = _grown(last, rows[turn], kept(before[turn]), links, turn == 0), sides[turn]
        rows[turn] = sides[turn].count()


def label_paths(edges: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``repo, source_label, target_label, path``: the labels on the shortest path, either way along edges, between the
    first nodes of the repository whose labels contain those of ``asked`` (``repo, source_label, target_label``).

    Of paths of the same length the smallest by the order of nodes counts; without a node or a path it is empty.
    Questions that name the same two nodes are one search. Nodes are numbered in their order over all repositories, so a
    search handles numbers only. Nodes without a label are told by their ids.
    """
    asked = stored(asked.select("repo", "source_label", "target_label").distinct())
    nodes = stored(with_row_number(nodes.select("repo", "id", "label", "ord"), ["repo", "ord"], "number").select("repo", "id", "label", F.col("number").alias("ord")))
    found = stored(find_in_repo(nodes, asked.select("repo", F.col("source_label").alias("wanted")).unionByName(asked.select("repo", F.col("target_label").alias("wanted")))))
    end = lambda label, name: found.select("repo", F.col("wanted").alias(label), F.col("ord").alias(name)).hint("merge")
    pairs = stored(asked.join(end("source_label", "source"), ["repo", "source_label"]).join(end("target_label", "target"), ["repo", "target_label"]))
    place = lambda name, at: keyed(nodes.select("repo", F.col("id").alias(name), F.col("ord").alias(at)))
    ends = edges.select("repo", "source", "target").join(place("source", "from"), ["repo", "source"]).join(place("target", "to"), ["repo", "target"])
    links = stored(_links(ends.select("repo", F.col("from").alias("source"), F.col("to").alias("target"))).select(F.col("id").alias("at"), "next"))
    steps = paths_between(links, pairs).select("source", "target", F.posexplode("path").alias("at", "ord"))
    named = steps.join(keyed(nodes.select("ord", F.coalesce("label", "id").alias("label"))), "ord")
    listed = named.groupBy("source", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("path"))
    told = pairs.join(listed.hint("merge"), ["source", "target"]).select("repo", "source_label", "target_label", "path")
    return asked.join(told.hint("merge"), ["repo", "source_label", "target_label"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))


def structural_context(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, summaries: DataFrame, gods: DataFrame, k: int = 5, most: int = 3) -> DataFrame:
    """``query_id, repo, rank, block``: what the graph says about the nodes of each question's scored chunks (``query_id,
    chunk_id, repo, source_path, section_header, rank, budget``).

    For each matched node, once and in the chunks' order: its community's summary (the first ``most`` communities of the
    repository that have one), then the node with its told neighbours each way. Repositories come in the order of their
    first chunk; a question's blocks stop once its token budget is used up, but the first is always told. A chunk is
    matched once however many questions have it; chunks without a path or header are left out.
    """
    asked = chunks.filter("source_path <> '' and section_header <> ''")
    places = checkpointed(match_chunks(asked.select("chunk_id", "repo", "source_path", "section_header").dropDuplicates(["chunk_id"]), nodes).select("chunk_id", "id"))
    told = nodes.select("repo", "id", "label", "community").join(keyed(places.select("id").distinct()), "id", "left_semi")
    matched = asked.join(keyed(places), "chunk_id").join(keyed(told), ["repo", "id"])
    once = checkpointed(matched.groupBy("query_id", "repo", "id").agg(F.min_by(F.struct("rank", "label", "community", "source_path", "budget"), "rank").alias("m")).select("query_id", "repo", "id", "m.*"))
    known = once.select("repo", "id").distinct()
    near = neighbors(both_ends(edges, known), nodes, 2 * k).join(keyed(known), ["repo", "id"], "left_semi").filter(F.col("relation").isin(*lexicons.TOLD_RELATIONS)).drop("rank")
    near = top_k(near, ["repo", "id", "direction"], k, F.col("ord"), F.col("neighbor"))
    ways = near.groupBy("repo", "id", "direction").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat("neighbor_label", F.lit(" ("), "relation", F.lit(")")).alias("t")))), lambda x: x["t"]), ", ").alias("t"))
    lists = ways.groupBy("repo", "id").agg(F.max(F.when(F.col("direction") == "outgoing", F.col("t"))).alias("out"), F.max(F.when(F.col("direction") == "incoming", F.col("t"))).alias("into"))
    tagged = once.join(gods.select("repo", "id", F.lit(" [god-node]").alias("tag")).distinct(), ["repo", "id"], "left")
    lines = tagged.join(lists, ["repo", "id"], "left").join(summaries.select("repo", "community", "summary"), ["repo", "community"], "left")
    first = lines.filter("summary is not null").groupBy("query_id", "repo", "community").agg(F.min("rank").alias("first_rank"))
    first = top_k(first, ["query_id", "repo"], most, F.col("first_rank")).drop("rank")
    lines = lines.join(first, ["query_id", "repo", "community"], "left")
    # The words and marks of a block.
    node = F.when(F.col("out").isNotNull() | F.col("into").isNotNull(), F.concat_ws("\n", F.concat(F.col("label"), F.lit(" ("), F.col("source_path"), F.lit(")"), F.coalesce("tag", F.lit("")), F.lit(":")), F.concat(F.lit("  chama/usa: "), F.col("out")), F.concat(F.lit("  chamado por: "), F.col("into"))))
    summary = F.when(F.col("first_rank") == F.col("rank"), F.concat(F.lit("Comunidade "), F.col("community"), F.lit(": "), F.col("summary")))
    parts = lines.select("query_id", "repo", "rank", "budget", F.concat_ws("\n", summary, node).alias("line")).filter("line <> ''")
    blocks = parts.groupBy("query_id", "repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("body"), F.min("rank").alias("rank"), F.max("budget").alias("budget"))
    full = blocks.select("query_id", "repo", "rank", "budget", F.concat(F.lit("[CONTEXTO ESTRUTURAL — "), F.col("repo"), F.lit("]\n"), F.col("body"), F.lit("\n[/CONTEXTO ESTRUTURAL — "), F.col("repo"), F.lit("]")).alias("block"))
    over = Window.partitionBy("query_id").orderBy("rank")  # at most one row a repository
    used = F.sum(estimated_tokens(F.col("block"))).over(over.rowsBetween(Window.unboundedPreceding, 0))
    return full.withColumns({"used": used, "place": F.row_number().over(over)}).filter("place = 1 or used <= budget").select("query_id", "repo", "rank", "block")


def both_ends(edges: DataFrame, known: DataFrame) -> DataFrame:
    """The edges at known nodes (``repo, id``), each once."""
    at = lambda end: edges.join(keyed(known.withColumnRenamed("id", end)), ["repo", end], "left_semi")
    return at("source").unionByName(at("target").join(keyed(known.withColumnRenamed("id", "source")), ["repo", "source"], "left_anti"))


def graph_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo, nodes, edges, communities, relations``, the last as a text in order of frequency."""
    n = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("community").alias("communities"))
    kinds = edges.groupBy("repo", "relation").agg(F.count(F.lit(1)).alias("n"))
    e = kinds.groupBy("repo").agg(F.sum("n").alias("edges"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "relation"))), lambda x: F.concat(x["relation"], F.lit(": "), (-x["o"]).cast("string"))), ", ").alias("relations"))
    return n.join(e, "repo", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def community_prompts(nodes: DataFrame, edges: DataFrame, repo_label: Column | None = None) -> DataFrame:
    """The facts that a model is to summarise for each large community: files, best connected symbols and edges."""
    files = community_files(nodes).groupBy("repo", "community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("  "), "source_file", F.lit(": "), "listed").alias("t")))), lambda x: x["t"]), "\n").alias("files"))
    best = top_k(degrees(edges, nodes).join(keyed(nodes.select("repo", "id", "label", "ord")), ["repo", "id"]), ["repo", "community"], 5, F.desc("degree"), F.col("ord"))
    symbols = best.groupBy("repo", "community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("  "), "label", F.lit(" (degree "), F.col("degree").cast("string"), F.lit(")")).alias("t")))), lambda x: x["t"]), "\n").alias("symbols"))
    inner = labelled(labelled(top_k(internal_edges(edges, nodes), ["repo", "community"], 10, F.col("ord")), nodes, "source", "a"), nodes, "target", "b")
    lines = inner.groupBy("repo", "community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("  "), "a", F.lit(" --"), "relation", F.lit("--> "), "b").alias("t")))), lambda x: x["t"]), "\n").alias("edges"))
    all_parts = large_communities(nodes).join(files, ["repo", "community"], "left").join(symbols, ["repo", "community"], "left").join(lines, ["repo", "community"], "left")
    text = F.concat(F.lit("Community "), F.col("community"), F.lit(" of "), repo_label if repo_label is not None else F.col("repo"), F.lit(", "), F.col("members").cast("string"), F.lit(" members\nFiles:\n"), F.coalesce("files", F.lit("  none")), F.lit("\nSymbols:\n"), F.coalesce("symbols", F.lit("  none")), F.lit("\nEdges:\n"), F.coalesce("edges", F.lit("  none")))
    return all_parts.select("repo", "community", "members", text.alias("prompt"))
