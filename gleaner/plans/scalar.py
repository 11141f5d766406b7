"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import lexicons, text
from gleaner.operators import governor
from gleaner.plans.registry import SQL_BLANKS, query, sql_list, table
from gleaner.sources import files

_SPLIT = "regexp_split_to_array(lower(text), '\\s+')"


def _sql_words(chars: str, source: str = "text") -> str:
    quoted = chars.replace("'", "''")
    return f"list_filter(list_transform(regexp_split_to_array(lower({source}), '\\s+'), lambda w: trim(w, '{quoted}')), lambda w: w <> '')"


def _sql_phrases(phrases) -> str:
    return "(" + " or ".join("contains(lower(text), '" + p.replace("'", "''") + "')" for p in phrases) + ")"




def _sql_graph(chars: str) -> str:
    return f"(list_has_any({_sql_words(chars)}, {sql_list(lexicons.GRAPH_WORDS)}) or {_sql_phrases(lexicons.GRAPH_PHRASES)})"


COMPLEX = f"""case when {_sql_graph(".,!?")} or {_sql_phrases((" and ", " or ", " not ", " && ", " || "))}
  or length(text) - length(replace(text, '?', '')) > 1 or len(list_filter({_SPLIT}, lambda w: w <> '')) > 8 then 'complex'
  when len(list_filter({_SPLIT}, lambda w: w <> '')) <= 3 then 'simple' else 'normal' end"""
_PUNCTUATION = ".,!?:;\"'()[]"


@query("select doc_id, substr(sha256(source || ':' || doc_id || ':' || text), 1, 16) as chunk_id from documents")
def chunk_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.content_hash(F.col("source"), F.col("doc_id").cast("string"), F.col("text")).alias("chunk_id"))


@query("select doc_id, ((('0x' || substr(sha256(doc_id::varchar), 1, 8))::bigint & 2147483647) << 32) | ('0x' || substr(sha256(doc_id::varchar), 9, 8))::bigint as point_id from documents")
def point_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.point_id(F.col("doc_id").cast("string")).alias("point_id"))


@query("select doc_id, len(t)::int as tokens, array_to_string(t, ' ') as joined from (select doc_id, regexp_extract_all(lower(strip_accents(text)), '[a-z0-9_]+') as t from documents)")
def tokenize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("tokens"), F.array_join("t", " ").alias("joined"))


@query("select doc_id, case when text = '' then 0 else greatest(1, floor(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) * 1.3::double)::int) end as tokens from documents")
def est_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@query(f"""select item_id, case when len(k) > 0 then array_to_string(k, ' ') else text end as keywords from (
  select item_id, text, list_filter({_sql_words(_PUNCTUATION)}, lambda w: not list_contains({sql_list(lexicons.STOP_WORDS)}, w) and length(w) > 2) as k from benchmark)""")
def keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.keywords(F.col("text")).alias("keywords"))


@query(f"select conv_id, turn, {COMPLEX} as complexity from conversations")
def complexity(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.complexity(F.col("text")).alias("complexity"))


@query(f"""with c as (select conv_id, turn, {COMPLEX} as kind from conversations), n as (select count(*) as size from documents),
k as (select conv_id, turn, size, case kind when 'simple' then 3 when 'complex' then 20 else 10 end as k from c, n)
select conv_id, turn, k, case when size <= 1000 then k else greatest(3, least(30, floor(k * (1 + log10(size / 1000)))::int)) end as scaled from k""")
def adaptive_k(spark, sf_dir):
    size = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("size"))
    kinds = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.adaptive_k(text.complexity(F.col("text")), 10).alias("k"))
    return kinds.crossJoin(F.broadcast(size)).select("conv_id", "turn", "k", text.scaled_k(F.col("k"), F.col("size")).alias("scaled"))


_LOCAL = f"list_has_any({_sql_words(_PUNCTUATION + '{}')}, {sql_list(lexicons.LOCAL_WORDS)})"
_STRUCT = _sql_graph(_PUNCTUATION + "{}")


#: The mode that a question's words ask for, in SQL.
HEURISTIC_MODE = f"case when {_LOCAL} and {_STRUCT} then 'RAG_AND_GRAPH' when {_STRUCT} then 'NO_CONTEXT' when {_LOCAL} then 'RAG_ONLY' else 'NO_CONTEXT' end"


@query(f"""with r as (select conv_id, turn, {_LOCAL} as l, {_STRUCT} as g from conversations)
select conv_id, turn, case when l and g then 'RAG_AND_GRAPH' when g then 'NO_CONTEXT' when l then 'RAG_ONLY' else 'NO_CONTEXT' end as mode,
(case when l and g then 0.7 when g then 0.5 when l then 0.7 else 0.6 end)::double as confidence from r""")
def route_heuristic(spark, sf_dir):
    routed = table(spark, sf_dir, "conversations").withColumn("r", text.heuristic_route(F.col("text")))
    return routed.select("conv_id", "turn", "r.mode", "r.confidence")


_SETTING = "case turn % 5 when 0 then 'auto' when 1 then 'rag_only' when 2 then 'graph_only' when 3 then 'both' else 'none' end"


@query(f"select conv_id, turn, case s when 'rag_only' then 'RAG_ONLY' when 'graph_only' then 'GRAPH_ONLY' when 'both' then 'RAG_AND_GRAPH' when 'none' then 'NO_CONTEXT' end as mode from (select conv_id, turn, {_SETTING} as s from conversations)")
def route_explicit(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.explicit_mode(F.expr(_SETTING)).alias("mode"))


_MODE = "case turn % 6 when 0 then 'NO_CONTEXT' when 1 then 'RAG_ONLY' when 2 then 'GRAPH_ONLY' when 3 then 'RAG_AND_GRAPH' when 4 then 'CLARIFY' else 'other' end"


@query(f"""select conv_id, turn, mode in ('RAG_ONLY', 'RAG_AND_GRAPH', 'CLARIFY', 'other') as use_notes, mode in ('RAG_ONLY', 'RAG_AND_GRAPH', 'CLARIFY', 'other') as use_code,
mode in ('GRAPH_ONLY', 'RAG_AND_GRAPH') as use_graph from (select conv_id, turn, {_MODE} as mode from conversations)""")
def route_intent(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("s", text.mode_sources(F.expr(_MODE))).select("conv_id", "turn", "s.use_notes", "s.use_code", "s.use_graph")


_REPLY = "case item_id % 3 when 0 then '<think>a\nb</think> route: rag_only\nReason: ' || text when 1 then 'ROUTE:  CLARIFY' else text end"


@query(f"""select item_id, nullif(upper(regexp_extract(c, '(?i)ROUTE:\\s*(NO_CONTEXT|RAG_ONLY|GRAPH_ONLY|RAG_AND_GRAPH|CLARIFY)', 1)), '') as mode,
coalesce(nullif(trim(regexp_extract(c, '(?i)REASON:\\s*(.+)', 1)), ''), 'LLM classification') as reason from (select item_id, trim(regexp_replace({_REPLY}, '(?s)<think>.*?</think>', '', 'g'), {SQL_BLANKS}) as c from benchmark)""")
def parse_route(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").withColumn("r", text.parsed_route(F.expr(_REPLY.replace("\n", "\\n")))).select("item_id", "r.mode", "r.reason")


_RERANK = "case vec_id % 4 when 0 then 'score: ' || (vec_id % 13) when 1 then (vec_id % 10) || '/10' when 2 then 'no idea' else '' end"


@query(f"""select vec_id, round(combined, 6) as combined from (select vec_id, case when s = '' then v else 0.6::double * (least(s::int, 10) / 10) + 0.4::double * v end as combined
from (select vec_id, label / 10.0::double as v, regexp_extract({_RERANK}, '\\b([0-9]{{1,2}})\\b', 1) as s from embeddings)) where combined >= 0.3::double""")
def rerank_combine(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", text.blended_score(F.expr(_RERANK), F.col("label") / F.lit(10.0)).alias("combined"))
    return rows.filter(F.col("combined") >= 0.3).select("vec_id", F.round("combined", 6).alias("combined"))


@query("""with f as (select item_id, 4000 + item_id::int as total, item_id % 2 = 1 as n, item_id // 2 % 2 = 1 as c, item_id // 4 % 2 = 1 as g from benchmark), a as (select *, n::int + c::int + g::int as k from f)
select item_id, case when not n then 0 when k = 1 then total when k = 3 then floor(total * 0.4::double)::int when c then total // 2 else floor(total * 0.6::double)::int end as notes,
case when not c then 0 when k = 1 then total when k = 3 then floor(total * 0.4::double)::int when n then total // 2 else floor(total * 0.6::double)::int end as code,
case when not g then 0 when k = 1 then total when k = 3 then floor(total * 0.2::double)::int else floor(total * 0.4::double)::int end as graph from a""")
def budget_alloc(spark, sf_dir):
    flag = lambda bit: F.expr(f"item_id div {bit} % 2 = 1")
    rows = table(spark, sf_dir, "benchmark").withColumn("b", text.budget_share((4000 + F.col("item_id")).cast("int"), flag(1), flag(2), flag(4)))
    return rows.select("item_id", "b.notes", "b.code", "b.graph")


_LABEL = "case p_partkey % 4 when 0 then '.' || p_name || '()' when 1 then p_name || ' (parte ' || p_size || ')' when 2 then p_name || ' (module-level)' else ' ' || p_name end"


@query(f"""select p_partkey, ltrim(rtrim(regexp_replace(regexp_replace(lower(trim({_LABEL}, {SQL_BLANKS})), '\\s*\\(parte\\s+[0-9]+\\)$', ''), '\\s*\\(module-level\\)$', ''), '()'), '.') as norm,
regexp_replace({_LABEL}, '[^a-zA-Z0-9_]', '_', 'g') as diagram_id from part""")
def norm_label(spark, sf_dir):
    label = F.expr(_LABEL)
    return table(spark, sf_dir, "part").select("p_partkey", text.normal_label(label).alias("norm"), text.diagram_id(label).alias("diagram_id"))


_LINKED = "case doc_id % 3 when 0 then replace(text, '. ', chr(10) || '- [[') || ']]' when 1 then '* [[' || source || ']]' || chr(10) || '[[' || lang || ']]' else text end"
_SECTION = "case doc_id % 11 when 0 then 'Files' else source end"


@query(f"""select doc_id, section in {tuple(lexicons.NAVIGATION_SECTIONS)} or len(l) = 0 or len(list_filter(l, lambda x: contains(x, '[[') and contains(x, ']]') and length(x) < 80)) / len(l) > 0.6 as navigates,
len(r) = 0 or len(list_filter(r, lambda x: regexp_matches(x, '^[\\s\\-\\*]*\\[\\[.*?\\]\\][\\s\\-\\*]*$'))) / len(r) > 0.7 as only_links
from (select doc_id, {_SECTION} as section, list_filter(list_transform(string_split(replace({_LINKED}, chr(13), chr(10)), chr(10)), lambda x: trim(x, {SQL_BLANKS})), lambda x: x <> '') as l,
list_filter(string_split({_LINKED}, chr(10)), lambda x: trim(x, {SQL_BLANKS}) <> '') as r from documents)""")
def nav_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_SECTION).alias("section"), F.expr(_LINKED).alias("t"))
    return docs.select("doc_id", text.navigates(F.col("section"), F.col("t")).alias("navigates"), text.only_links(F.col("t")).alias("only_links"))


_FRONT = "case doc_id % 2 when 0 then '---' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || text else text end"


@query(f"select doc_id, trim(regexp_replace({_FRONT}, '\\A---\\s*\\n(?s:.*?)\\n---\\s*\\n', ''), {SQL_BLANKS}) as body from documents")
def strip_frontmatter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.without_front_matter(F.expr(_FRONT)).alias("body"))


_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?].*$', '') || case page_id % 7 when 0 then '/venv3/a.py' when 1 then '/src/App.TS' when 2 then '/x.egg-info/b.md' when 3 then '/logo.PNG' when 4 then '/Makefile' when 5 then '/docs/index.MD' else '/build/c.py' end"


def _sql_skipped() -> str:
    dirs = "string_split(p, '/')[1:-2]"
    return (
        f"(len(list_filter({dirs}, lambda d: list_contains({sql_list(lexicons.SKIPPED_DIRS)}, d) or ends_with(d, '.egg-info') or starts_with(lower(d), '.venv') or starts_with(lower(d), 'venv') or lower(d) = 'env')) > 0"
        f" or list_contains({sql_list(lexicons.SKIPPED_FILES)}, string_split(p, '/')[-1]) or list_contains({sql_list(lexicons.BINARY_SUFFIXES)}, s))"
    )


@query(f"""select page_id, p as path, s as suffix, not {_sql_skipped()} and list_contains({sql_list([*files.CODE_SUFFIXES, *lexicons.DOC_SUFFIXES])}, s) as indexed
from (select page_id, p, lower(regexp_extract(p, '[^/](\\.[^./]*)$', 1)) as s from (select page_id, {_PATH} as p from pages))""")
def scan_repo(spark, sf_dir):
    path = F.col("path")
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path")).select("page_id", "path", files.suffix(path).alias("suffix"), files.indexed(path).alias("indexed"))


@query(f"select page_id, len(list_filter(string_split(p, '/'), lambda x: regexp_matches(x, '^(.*\\.egg-info|venv.*|.*\\.PNG)$'))) > 0 as excluded, list_has_any(string_split(p, '/'), ['build', 'docs']) as named from (select page_id, {_PATH} as p from pages)")
def exclude_paths(spark, sf_dir):
    path = F.col("path")
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path"))
    return rows.select("page_id", files.matches_glob(path, ["*.egg-info", "venv*", "*.PNG"]).alias("excluded"), files.has_part(path, ["build", "docs"]).alias("named"))


@query("select m.user_id, coalesce(f.enabled, false) as use_rag from (select distinct user_id from events) m left join (select distinct user_id, true as enabled from events where event_type = 'purchase') f using (user_id)")
def rag_toggle(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    enabled = events.filter("event_type = 'purchase'").select("user_id", F.lit(True).alias("enabled")).distinct()
    return events.select("user_id").distinct().join(enabled, "user_id", "left").select("user_id", F.coalesce("enabled", F.lit(False)).alias("use_rag"))


@query("select event_id, round(value, 2) as avg10, (user_id + 0.5)::double as avg60, event_id::double as total from events")
def psi_parse(spark, sf_dir):
    line = F.concat(F.lit("some avg10="), F.round("value", 2).cast("decimal(20,2)").cast("string"), F.lit(" avg60="), F.col("user_id").cast("string"), F.lit(".5 bad=x total="), F.col("event_id").cast("string"))
    parsed = table(spark, sf_dir, "events").select("event_id", governor.pressure_line(line).alias("m"))
    return parsed.select("event_id", F.col("m")["avg10"].alias("avg10"), F.col("m")["avg60"].alias("avg60"), F.col("m")["total"].alias("total"))


@query("""with m as (select c_custkey, 1 + c_custkey::int % 64 as cores, 2 + c_custkey::int % 37 as total, 1 + c_custkey::int % 23 as free, c_custkey::int % 13 as vram from customer),
r as (select *, greatest(1, least(cores // 6, 4)) as j, case when vram >= 6 then 50 when total < 8 then 15 when total < 16 then 25 else 30 end as b,
case when free < 8 then 1 when free < 16 then 2 else least(3, greatest(1, cores // 8)) end as p from m)
select c_custkey, (case when free < 4 then greatest(1, j // 2) else j end)::int as jobs, (case when free < 4 then greatest(10, b // 2) else b end)::int as batch, (case when free < 4 then 1 else p end)::int as parsers from r""")
def autotune(spark, sf_dir):
    size = lambda base, step: base + F.col("c_custkey").cast("int") % step
    return table(spark, sf_dir, "customer").withColumn("t", governor.tuned(size(1, 64), size(2, 37), size(1, 23), size(0, 13))).select("c_custkey", "t.jobs", "t.batch", "t.parsers")


_SAMPLES = {
    "ram_percent": "value % 101", "swap_percent": "value * 3 % 83", "disk_free_gb": "0.9 + event_id % 200", "cpu_percent": "value * 7 % 100",
    "swap_used_gb": "value * 5 % 11 / 8", "psi_memory": "value * 2 % 29", "psi_io": "value * 9 % 43", "psi_cpu": "value * 4 % 53",
}


def samples(spark, sf_dir):
    """Resource samples of machines (users) made of the events."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("machine"), "ts", "event_id", F.floor(F.abs("value") * 10).cast("int").alias("value"))
    return events.select("sample_id", "machine", "ts", *(F.expr(f"cast({e} as double)").alias(n) for n, e in _SAMPLES.items()))


@query(f"""with e as (select event_id, user_id, ts, floor(abs(value) * 10)::int as value from events),
s as (select event_id as sample_id, user_id as machine, ts, {", ".join(f"({e})::double as {n}" for n, e in _SAMPLES.items())} from e),
d as (select *, round(coalesce(swap_used_gb - lag(swap_used_gb) over (partition by machine order by ts, sample_id), 0), 3) as delta from s)
select sample_id, delta as swap_delta_gb, case when disk_free_gb < 1 then 'ABORT' when ram_percent >= 90 then 'ABORT' when swap_percent >= 80 then 'ABORT' when swap_percent >= 60 then 'PAUSE' when ram_percent >= 80 then 'PAUSE'
when swap_percent >= 40 then 'REDUCE' when ram_percent >= 70 then 'REDUCE' when delta > 0.5 then 'THROTTLE' when psi_memory > 25 then 'PAUSE' when psi_memory > 10 then 'REDUCE' when psi_io > 40 then 'PAUSE' when psi_io > 20 then 'REDUCE'
when psi_memory > 5 or psi_io > 10 then 'THROTTLE' when cpu_percent > 85 then 'THROTTLE' when psi_cpu > 50 then 'THROTTLE' else 'CONTINUE' end as action from d""")
def governor_actions(spark, sf_dir):
    return governor.actions(samples(spark, sf_dir), "machine", "ts").select("sample_id", "swap_delta_gb", "action")
