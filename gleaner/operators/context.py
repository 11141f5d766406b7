"""The context of many questions at once: routes, budgets and blocks of notes, code and graphs.

A question's passages are the first few of a search, so what is gathered of one question is bounded by the search and
its token budget; questions are groups like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import budget_share, context_instruction, estimated_tokens, explicit_mode, heuristic_route, mode_sources
from gleaner.operators.ranking import within_budget

#: Modes without a search.
IDLE = ("NO_CONTEXT", "CLARIFY")


def routed(asked: DataFrame) -> DataFrame:
    """Add ``mode`` and which sources it uses to questions (``query_id, text, setting``): the setting's mode, or where it
    fixes none, that of the question's words."""
    chosen = asked.withColumn("mode", F.coalesce(explicit_mode(F.col("setting")), heuristic_route(F.col("text"))["mode"]))
    used, idle = mode_sources(F.col("mode")), F.col("mode").isin(*IDLE)
    return chosen.withColumns({n: ~idle & used[n] for n in ("use_notes", "use_code", "use_graph")})


def first_lines(text: Column, budget: Column) -> Column:
    """A text that fits into a token budget as it is, else its first lines that do; the first line stays in any case."""
    whole = F.split(text, "\n", -1)
    lines = F.transform(whole, lambda x, i: F.when(i < F.size(whole) - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("used"), F.lit(True).alias("open"))

    def step(state: Column, line: Column) -> Column:
        tokens = state["used"] + estimated_tokens(line)
        fits = state["open"] & ((tokens <= budget) | (state["kept"] == ""))
        return F.struct(F.when(fits, F.concat(state["kept"], line)).otherwise(state["kept"]).alias("kept"), F.when(fits, tokens).otherwise(state["used"]).alias("used"), fits.alias("open"))

    return F.when(estimated_tokens(text) <= budget, text).otherwise(F.rtrim(F.aggregate(lines, start, step)["kept"], F.lit(" \n\t\r")))


def _two_places(score: Column) -> Column:
    return F.format_number(score, 2)  # halves go to the even digit


def joined(rows: DataFrame, by: list[str], order: str, text: str, between: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x[text]), between).alias(text), F.min(order).alias(order))


def _passages(rows: DataFrame, name: Column, section: Column) -> DataFrame:
    """Add ``line``: the passage under its name, section and score, and an empty line."""
    label = F.when(F.coalesce(section, F.lit("")) == "", F.concat(F.lit("["), name, F.lit("]"))).otherwise(F.concat(F.lit("["), name, F.lit(" / "), section, F.lit("]")))
    return rows.withColumn("line", F.concat(label, F.lit("  score="), _two_places(F.col("score")), F.lit("\n"), F.col("text"), F.lit("\n")))


def with_budgets(routes: DataFrame, notes: DataFrame, code: DataFrame, total: int, graph: Column) -> DataFrame:
    """Add how many notes and passages of code each question has, the best score and ``share``: the tokens of each source.
    ``graph``: whether the question's context has a graph."""
    counts = notes.select("query_id", "score", F.lit(1).alias("n"), F.lit(0).alias("c")).unionByName(code.select("query_id", "score", F.lit(0).alias("n"), F.lit(1).alias("c")))
    counts = counts.groupBy("query_id").agg(F.sum("n").alias("notes"), F.sum("c").alias("codes"), F.max("score").alias("best"))
    state = routes.join(counts, "query_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("notes", "codes")})
    return state.withColumn("share", budget_share(F.lit(total), F.col("notes") > 0, F.col("codes") > 0, graph))


def assembled(routes: DataFrame, notes: DataFrame, code: DataFrame, graphs: DataFrame, total: int = 4000, least: float = 0.5, count: int = 1) -> DataFrame:
    """``query_id, mode, sources, accepted, context``, a row for each question of ``routes`` (``query_id, mode``).

    ``notes`` (``query_id, rank, score, title, section, text``) and ``code`` (``query_id, rank, score, repo, source_path,
    section, text``) are what searches gave, ``graphs`` (``query_id, graph``) is one block. Passages must reach the least
    best score and number, or there is a graph alone; else the context is empty. Each source gets its share of the token
    budget: passages go as wholes in the order of their rank, the first in any case; a graph ends after a line. Code
    comes in a block for each repository, in the order of their first passages. A text that is null is empty.
    """
    given = routes.join(graphs.select("query_id", "graph"), "query_id", "left")
    state = with_budgets(given, notes, code, total, F.col("graph").isNotNull())
    found = F.col("notes") + F.col("codes")
    state = state.withColumn("accepted", F.when(found > 0, (F.col("best") >= least) & (found >= count)).otherwise(F.col("graph").isNotNull()))
    good = state.filter("accepted").select("query_id", "share")
    kept = lambda rows, source: within_budget(rows.withColumn("text", F.coalesce("text", F.lit(""))).join(good.select("query_id", F.col(f"share.{source}").alias("budget")), "query_id"), ["query_id"], "text", F.col("budget"), F.col("rank"))
    # The marks of blocks.
    note_lines = joined(_passages(kept(notes, "notes"), F.col("title"), F.col("section")), ["query_id"], "rank", "line", "\n")
    note_block = note_lines.select("query_id", F.concat(F.lit("[CONTEXTO DAS NOTAS PESSOAIS]\n"), "line", F.lit("\n[/CONTEXTO DAS NOTAS]")).alias("note_block"))
    code_lines = joined(_passages(kept(code, "code"), F.col("source_path"), F.col("section")), ["query_id", "repo"], "rank", "line", "\n")
    framed = code_lines.withColumn("line", F.concat(F.lit("[CONTEXTO DO CÓDIGO — "), "repo", F.lit("]\n"), "line", F.lit("\n[/CONTEXTO DO CÓDIGO — "), "repo", F.lit("]")))
    code_block = joined(framed, ["query_id"], "rank", "line", "\n\n").select("query_id", F.col("line").alias("code_block"))
    told = state.join(note_block, "query_id", "left").join(code_block, "query_id", "left")
    cut = F.when(F.col("accepted") & F.col("graph").isNotNull(), first_lines(F.col("graph"), F.col("share.graph")))
    sources = F.when(~F.col("accepted"), "none").when((found > 0) & F.col("graph").isNotNull(), "graph+rag").when(found > 0, "rag").otherwise("graph")
    told = told.withColumns({"sources": sources, "cut": cut})
    context = F.concat_ws("\n\n", "note_block", "code_block", "cut", context_instruction(F.col("sources")))
    return told.select("query_id", "mode", "sources", "accepted", F.when(F.col("accepted"), context).otherwise("").alias("context"))
