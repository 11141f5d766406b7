"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from gleaner.functions import lexicons

SPACES = r"\s+"
BLANKS = " \t\n\r\x0b\x0c"
UNITS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def content_hash(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def point_id(text: Column) -> Column:
    """A non-negative 63-bit number from the first 8 bytes of SHA-256: sign bit cleared, read as two halves."""
    digest = F.sha2(text, 256)
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1).bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(half(9))


@pandas_udf(StringType())
def fold_accents(texts: pd.Series) -> pd.Series:
    """Decompose (NFKD) and drop combining marks: there is no built-in for it."""
    fold = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn")
    return texts.map(lambda t: t if t is None or t.isascii() else fold(t))


def tokenize(text: Column) -> Column:
    """Words of unaccented lower-case letters, digits and underscores."""
    ascii_only = text.rlike(r"\A\p{ASCII}*\z")  # such texts never leave the JVM
    folded = F.when(ascii_only, text).otherwise(fold_accents(F.when(~ascii_only, text)))
    return F.regexp_extract_all(F.lower(folded), F.lit("[a-z0-9_]+"), F.lit(0))


def two_places(number: Column) -> Column:
    """A number with two places as C and DuckDB print it: of the exact binary value, halves to the even digit. Java's
    ``%.2f`` rounds the shortest decimal half up, so 0.125 and 0.285 come out as 0.13 and 0.29 there."""
    return F.call_function("format_number", number.cast("double"), F.lit("0.00"))


def estimated_tokens(text: Column) -> Column:
    """1.3 for each word or sign, 1 at least; 0 for the empty text."""
    units = F.size(F.regexp_extract_all(text, F.lit(UNITS), F.lit(0)))
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.floor(units * F.lit(1.3)).cast("int")))


def trim_chars(word: Column, chars: str) -> Column:
    return F.btrim(word, F.lit(chars))


def words(text: Column, chars: str) -> Column:
    """Lower-case words between white space, without the given characters at their ends; empty ones are dropped."""
    return F.filter(F.transform(F.split(F.lower(text), SPACES), lambda w: trim_chars(w, chars)), lambda w: w != "")


def keywords(text: Column) -> Column:
    """Words of more than 2 characters that are no stop-words, joined by spaces; the text itself if there are none."""
    kept = F.filter(words(text, ".,!?:;\"'()[]"), lambda w: ~w.isin(lexicons.STOP_WORDS) & (F.length(w) > 2))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(text)


def _has_any(found: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, wanted)))


def _has_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def complexity(query: Column) -> Column:
    """complex (relations, booleans, several questions or over 8 words), simple (up to 3 words) or normal."""
    low = F.lower(query)
    count = F.size(F.filter(F.split(low, SPACES), lambda w: w != ""))
    graph = _has_any(words(query, ".,!?"), lexicons.GRAPH_WORDS) | _has_phrase(low, lexicons.GRAPH_PHRASES)
    several = F.length(low) - F.length(F.replace(low, F.lit("?"), F.lit(""))) > 1
    hard = graph | _has_phrase(low, (" and ", " or ", " not ", " && ", " || ")) | several | (count > 8)
    return F.when(hard, "complex").when(count <= 3, "simple").otherwise("normal")


def adaptive_k(kind: Column, k: int) -> Column:
    return F.when(kind == "simple", max(3, k // 3)).when(kind == "complex", min(2 * k, 20)).otherwise(k)


def scaled_k(k: Column, size: Column) -> Column:
    """More results from collections of over 1000 rows, from 3 to 30."""
    grown = F.floor(k * (1 + F.log10(size / 1000))).cast("int")
    return F.when(size <= 1000, k).otherwise(F.greatest(F.lit(3), F.least(F.lit(30), grown)))


def heuristic_route(query: Column) -> Column:
    """struct(mode, confidence, reason) from the words of a query."""
    found = words(query, ".,!?:;\"'()[]{}")
    local = _has_any(found, lexicons.LOCAL_WORDS)
    graph = _has_any(found, lexicons.GRAPH_WORDS) | _has_phrase(F.lower(query), lexicons.GRAPH_PHRASES)
    as_route = lambda mode, confidence, reason: F.struct(F.lit(mode).alias("mode"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
    return (
        F.when(local & graph, as_route("RAG_AND_GRAPH", 0.7, "local and structural words"))
        .when(graph, as_route("NO_CONTEXT", 0.5, "structural words without a local one"))
        .when(local, as_route("RAG_ONLY", 0.7, "local words"))
        .otherwise(as_route("NO_CONTEXT", 0.6, "a general question"))
    )


def explicit_mode(setting: Column) -> Column:
    """The mode that a setting fixes; null where the query decides."""
    return F.when(setting == "rag_only", "RAG_ONLY").when(setting == "graph_only", "GRAPH_ONLY").when(setting == "both", "RAG_AND_GRAPH").when(setting == "none", "NO_CONTEXT")


def mode_sources(mode: Column) -> Column:
    """struct(use_notes, use_code, use_graph); unknown modes use notes and code."""
    names = ("use_notes", "use_code", "use_graph")
    flags = lambda key: F.struct(*(F.lit(v).alias(n) for n, v in zip(names, lexicons.MODE_SOURCES[key])))
    out = F.when(mode == "NO_CONTEXT", flags("NO_CONTEXT"))
    for key in ("GRAPH_ONLY", "RAG_AND_GRAPH"):
        out = out.when(mode == key, flags(key))
    return out.otherwise(flags("RAG_ONLY"))


def parsed_route(reply: Column) -> Column:
    """struct(mode, reason) from a model's reply; the mode is null if the reply names none."""
    clean = F.btrim(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), F.lit(BLANKS))
    mode = F.upper(F.regexp_extract(clean, r"(?i)ROUTE:\s*(NO_CONTEXT|RAG_ONLY|GRAPH_ONLY|RAG_AND_GRAPH|CLARIFY)", 1))
    reason = F.trim(F.regexp_extract(clean, r"(?i)REASON:\s*(.+)", 1))
    return F.struct(F.when(mode != "", mode).alias("mode"), F.when(reason != "", reason).otherwise("LLM classification").alias("reason"))


def blended_score(reply: Column, score: Column) -> Column:
    """0.6 of the relevance (0 to 10) that a reply states and 0.4 of the vector score; that score if it states none."""
    stated = F.regexp_extract(reply, r"\b([0-9]{1,2})\b", 1)
    return F.when(stated == "", score).otherwise(F.lit(0.6) * (F.least(stated.cast("int"), F.lit(10)) / 10) + F.lit(0.4) * score)


def normal_label(label: Column) -> Column:
    """A symbol's label for comparison: lower case, without part and module marks, final brackets and first dots."""
    s = F.btrim(F.lower(label), F.lit(BLANKS))
    s = F.regexp_replace(s, r"\s*\(parte\s+[0-9]+\)$", "")
    s = F.regexp_replace(s, r"\s*\(module-level\)$", "")
    return F.ltrim(F.rtrim(s, F.lit("()")), F.lit("."))


def diagram_id(label: Column) -> Column:
    return F.regexp_replace(label, "[^a-zA-Z0-9_]", "_")


def budget_share(total: Column, notes: Column, code: Column, graph: Column) -> Column:
    """struct(notes, code, graph): how a token budget is split between the sources that have something."""
    active = notes.cast("int") + code.cast("int") + graph.cast("int")
    part = lambda share: F.floor(total * F.lit(share)).cast("int")
    three = active == 3
    zero = F.lit(0)
    half = F.floor(total / 2).cast("int")
    return F.struct(
        F.when(~notes, zero).when(active == 1, total).when(three, part(0.4)).when(code, half).otherwise(part(0.6)).alias("notes"),
        F.when(~code, zero).when(active == 1, total).when(three, part(0.4)).when(notes, half).otherwise(part(0.6)).alias("code"),
        F.when(~graph, zero).when(active == 1, total).when(three, part(0.2)).otherwise(part(0.4)).alias("graph"),
    )


def navigates(section: Column, text: Column) -> Column:
    """Whether a passage only navigates: its section says so, or over 0.6 of its lines are short links, or it is blank."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    links = F.filter(lines, lambda x: F.contains(x, F.lit("[[")) & F.contains(x, F.lit("]]")) & (F.length(x) < 80))
    return section.isin(*lexicons.NAVIGATION_SECTIONS) | (F.size(lines) == 0) | (F.size(links) / F.size(lines) > 0.6)


def only_links(section_text: Column) -> Column:
    """Whether over 0.7 of a section's lines are list items of one wiki link, or it is blank."""
    lines = F.filter(F.split(section_text, r"\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    links = F.filter(lines, lambda x: x.rlike(r"^[\s\-\*]*\[\[.*?\]\][\s\-\*]*$"))
    return (F.size(lines) == 0) | (F.size(links) / F.size(lines) > 0.7)


def without_front_matter(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\A---\s*\n(?s:.*?)\n---\s*\n", ""), F.lit(BLANKS))


def context_instruction(sources: Column) -> Column:
    """The sources that a context came from decide which instruction follows it."""
    return F.when(sources == "rag", "answer from the passages").when(sources == "graph", "answer from the structure").when(sources == "graph+rag", "answer from passages and structure")
