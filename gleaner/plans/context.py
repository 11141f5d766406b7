"""The context of questions out of notes, code and graphs, and what graphs say about passages of code."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import lexicons
from gleaner.operators import context, graph
from gleaner.operators.ordering import checkpointed
from gleaner.plans import graphs, search
from gleaner.plans.registry import SQL_BLANKS, query, table
from gleaner.plans.scalar import HEURISTIC_MODE

BUDGET = 4000
_CODE_OF = {"repo": graphs._CHUNK["repo"], "source_path": graphs._CHUNK["source_path"], "section_header": graphs._CHUNK["section_header"]}
_TOKENS = "case when {0} = '' then 0 else greatest(1, floor(len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) * 1.3::double)::int) end"
_SUMMARIES = "sm as (select repo, community, 'about ' || community || ' with ' || count(*) as summary from n group by repo, community having count(*) >= 5)"
_GODS = """gw as (select repo, source as id from e union all select repo, target from e), gd as (select * from (select n.repo, n.id, n.label, n.source_file, count(*) as degree, row_number() over (partition by n.repo order by count(*) desc, n.ord)::int as rank
from gw join n using (repo, id) group by n.repo, n.id, n.label, n.source_file, n.ord) where rank <= 5)"""


#: Names of its own: a query with an index of words has a ``w`` already.
_BOTH = graphs._BOTH.replace("w as (", "bw as (", 1).replace("from w ", "from bw ").replace("f as (", "bf as (", 1).replace("from f)", "from bf)")


def structural_sql(chunks: str) -> str:
    """The blocks ``sb`` of graphs for the rows of ``chunks``, after the graph's own tables, summaries and gods."""
    norm = graphs._NORM
    return f"""sx as (select repo, source_file, {norm.format("label")} as norm, arg_max(id, ord) as id, min(ord) as ord from n where source_file <> '' and label <> '' group by all),
sc as (select distinct chunk_id, repo, source_path, section_header, {norm.format("section_header")} as asked from {chunks} where source_path <> '' and section_header <> ''),
sp as (select chunk_id, id, ord, case when source_path = source_file and norm = asked then 1 when norm = asked then 2 else 3 end as tier from sc join sx on sc.repo = sx.repo
where (ends_with(source_path, source_file) or ends_with(source_file, source_path)) and (norm = asked or contains(norm, asked) or contains(asked, norm))),
st as (select chunk_id, arg_min(id, tier::bigint * 1000000000 + ord) as id from sp group by chunk_id),
so as (select query_id, c.repo, st.id, min(rank) as rank, arg_min(c.source_path, rank) as source_path, max(budget) as budget from {chunks} c join st using (chunk_id) group by all), {_BOTH},
sn as (select v.*, coalesce(o.label, neighbor) as name, row_number() over (partition by v.repo, v.id, direction order by v.ord, neighbor) as place from v left join n o on v.repo = o.repo and v.neighbor = o.id where rank <= 10 and relation in {lexicons.TOLD_RELATIONS}),
sl as (select repo, id, string_agg(name || ' (' || relation || ')', ', ' order by place) filter (where direction = 'outgoing') as o, string_agg(name || ' (' || relation || ')', ', ' order by place) filter (where direction = 'incoming') as i from sn where place <= 5 group by all),
sy as (select so.*, n.label, n.community, sl.o, sl.i, sm.summary, case when gd.id is not null then ' [god-node]' else '' end as tag from so join n on n.repo = so.repo and n.id = so.id left join sl on sl.repo = so.repo and sl.id = so.id
left join sm on sm.repo = so.repo and sm.community = n.community left join gd on gd.repo = so.repo and gd.id = so.id),
sf as (select * from (select query_id, repo, community, min(rank) as first_rank, row_number() over (partition by query_id, repo order by min(rank)) as place from sy where summary is not null group by query_id, repo, community) where place <= 3),
sr as (select sy.query_id, sy.repo, rank, budget, concat_ws(chr(10), case when first_rank = rank then 'Comunidade ' || sy.community || ': ' || summary end,
case when o is not null or i is not null then concat_ws(chr(10), label || ' (' || source_path || ')' || tag || ':', '  chama/usa: ' || o, '  chamado por: ' || i) end) as line
from sy left join sf on sf.query_id = sy.query_id and sf.repo = sy.repo and sf.community = sy.community),
su as (select query_id, repo, min(rank) as rank, max(budget) as budget, '[CONTEXTO ESTRUTURAL — ' || repo || ']' || chr(10) || string_agg(line, chr(10) order by rank) || chr(10) || '[/CONTEXTO ESTRUTURAL — ' || repo || ']' as block from sr where line <> '' group by query_id, repo),
sb as (select * from (select *, row_number() over (partition by query_id order by rank) as place, sum({_TOKENS.format("block")}) over (partition by query_id order by rank) as used from su) where place = 1 or used <= budget)"""


@query(f"""with {graphs._GRAPH}, {_SUMMARIES}, {_GODS}, gc as (select a.ord as query_id, b.ord as chunk_id, b.repo, b.source_path, b.section_header, b.ord - a.ord as rank, 1000 as budget
from n a join (select p_partkey as ord, {", ".join(f"{e} as {k}" for k, e in _CODE_OF.items())} from part) b on b.ord between a.ord and a.ord + 9 where a.ord % 100 = 0), {structural_sql("gc")} select query_id, repo, block from sb""")
def graph_context(spark, sf_dir):
    """What the graphs say about ten passages of code for each of many questions, here from every hundredth symbol on."""
    chunks = graphs.code_chunks(spark, sf_dir)
    first = F.expr("chunk_id div 100 * 100")
    asked = chunks.filter("chunk_id % 100 < 10").withColumns({"query_id": first, "rank": F.col("chunk_id") - first, "budget": F.lit(1000)})
    told = graph.structural_context(asked, graphs.nodes(spark, sf_dir), graphs.edges(spark, sf_dir), graphs.summaries(spark, sf_dir), graphs.gods(spark, sf_dir))
    return told.select("query_id", "repo", "block")


_SETTING = "case item_id % 5 when 1 then 'rag_only' when 2 then 'graph_only' when 3 then 'both' when 4 then 'none' else 'auto' end"


@query(f"""with {search.ASKED_LISTS}, rt as (select item_id as query_id, coalesce(case {_SETTING} when 'rag_only' then 'RAG_ONLY' when 'graph_only' then 'GRAPH_ONLY' when 'both' then 'RAG_AND_GRAPH' when 'none' then 'NO_CONTEXT' end, {HEURISTIC_MODE}) as mode from benchmark),
hb as (select 'notes' as collection, *, 'b' as side from b union all select 'code', *, 'b' from b where doc_id in (select p_partkey from part) union all select 'notes', *, 'd' from d union all select 'code', *, 'd' from d where doc_id in (select p_partkey from part)),
hu as (select *, row_number() over (partition by collection, query_id, variant, side order by score desc, doc_id) as rank from hb),
hf as (select collection, query_id, variant, doc_id, round(sum(1.0::double / (2 + rank - 1)), 6) as score from hu join k using (query_id) where rank <= 2 * least(3 * k, 50) group by all),
hh as (select * from (select *, row_number() over (partition by collection, query_id, variant order by score desc, doc_id) as rank from hf) join k using (query_id) where rank <= least(3 * k, 50)),
hm as (select collection, query_id, doc_id, any_value(k) as k, max(score) as score from hh group by all),
hl as (select hm.*, source, lang, text, list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda x: trim(x, {SQL_BLANKS})), lambda x: x <> '') as lines from hm join documents using (doc_id)),
hn as (select * from hl where collection = 'code' or len(lines) > 0 and len(list_filter(lines, lambda x: contains(x, '[[') and contains(x, ']]') and length(x) < 80)) / len(lines) <= 0.6),
ht as (select * from (select *, max(score) over (partition by collection, query_id) as top from hn) where score >= greatest(0.45::double, top * 0.75::double)),
hk as (select * replace (coalesce(text, '') as text) from (select *, row_number() over (partition by collection, query_id order by score desc, doc_id)::bigint as rank from ht) join rt using (query_id) where rank <= k and mode in ('RAG_ONLY', 'RAG_AND_GRAPH')),
{graphs._GRAPH}, {_SUMMARIES}, {_GODS}, pc as (select p_partkey as doc_id, {", ".join(f"{e} as {k}" for k, e in _CODE_OF.items())} from part),
hp as (select query_id, count(*) filter (where collection = 'notes') as notes, count(*) filter (where collection = 'code') as codes, max(score) as best from hk group by query_id),
gc as (select query_id::varchar as query_id, doc_id as chunk_id, pc.repo, pc.source_path, pc.section_header, hk.rank, case when notes > 0 then floor({BUDGET} * 0.2::double)::int else floor({BUDGET} * 0.4::double)::int end as budget from hk join hp using (query_id) join pc using (doc_id) where collection = 'code' and mode = 'RAG_AND_GRAPH'
union all select 'all', -1 - n.ord, gd.repo, gd.source_file, gd.label, row_number() over (order by gd.repo, gd.rank), {BUDGET} from gd join n using (repo, id) where repo in (select repo from sm)), {structural_sql("gc")},
sg as (select query_id, string_agg(block, chr(10) || chr(10) order by rank) as graph from sb group by query_id),
sq as (select rt.query_id, mode, coalesce(notes, 0) as notes, coalesce(codes, 0) as codes, best, graph from rt left join hp using (query_id) left join sg on mode = 'GRAPH_ONLY' and sg.query_id = 'all' or mode = 'RAG_AND_GRAPH' and sg.query_id = rt.query_id::varchar),
ss as (select *, case when notes + codes > 0 then best >= 0.5::double else graph is not null end as accepted, (notes > 0)::int + (codes > 0)::int + (graph is not null)::int as kinds from sq),
sh as (select *, case when notes = 0 then 0 when kinds = 1 then {BUDGET} when kinds = 3 then floor({BUDGET} * 0.4::double)::int when codes > 0 then {BUDGET} // 2 else floor({BUDGET} * 0.6::double)::int end as nb,
case when codes = 0 then 0 when kinds = 1 then {BUDGET} when kinds = 3 then floor({BUDGET} * 0.4::double)::int when notes > 0 then {BUDGET} // 2 else floor({BUDGET} * 0.6::double)::int end as cb,
case when graph is null then 0 when kinds = 1 then {BUDGET} when kinds = 3 then floor({BUDGET} * 0.2::double)::int else floor({BUDGET} * 0.4::double)::int end as gb from ss),
kb as (select hk.*, case collection when 'notes' then nb else cb end as budget, sum({_TOKENS.format("text")}) over (partition by hk.query_id, collection order by hk.rank) as used from hk join sh using (query_id) where accepted),
kl as (select kb.*, pc.repo, case collection when 'notes' then '[' || source || '/' || kb.doc_id || ' / ' || lang || ']' else '[' || source_path || ' / ' || section_header || ']' end || '  score=' || printf('%.2f', score) || chr(10) || text || chr(10) as line from kb left join pc on pc.doc_id = kb.doc_id where kb.rank = 1 or used <= budget),
bn as (select query_id, '[CONTEXTO DAS NOTAS PESSOAIS]' || chr(10) || string_agg(line, chr(10) order by rank) || chr(10) || '[/CONTEXTO DAS NOTAS]' as note_block from kl where collection = 'notes' group by query_id),
br0 as (select query_id, min(rank) as rank, '[CONTEXTO DO CÓDIGO — ' || repo || ']' || chr(10) || string_agg(line, chr(10) order by rank) || chr(10) || '[/CONTEXTO DO CÓDIGO — ' || repo || ']' as block from kl where collection = 'code' group by query_id, repo),
bc as (select query_id, string_agg(block, chr(10) || chr(10) order by rank) as code_block from br0 group by query_id),
gl as (select query_id, gb, graph, unnest(string_split(graph, chr(10))) as line, generate_subscripts(string_split(graph, chr(10)), 1) as line_no, len(string_split(graph, chr(10))) as line_count from sh where accepted and graph is not null),
gt as (select *, sum({_TOKENS.format("(line || case when line_no < line_count then chr(10) else '' end)")}) over (partition by query_id order by line_no) as used from gl),
gg as (select query_id, case when {_TOKENS.format("any_value(graph)")} <= any_value(gb) then any_value(graph) else rtrim(string_agg(line, chr(10) order by line_no) filter (where line_no = 1 or used <= gb), ' ' || chr(10) || chr(9) || chr(13)) end as cut from gt group by query_id),
sw as (select *, case when not accepted then 'none' when notes + codes > 0 and graph is not null then 'graph+rag' when notes + codes > 0 then 'rag' else 'graph' end as sources from sh)
select query_id, mode, sources, accepted, case when accepted then concat_ws(chr(10) || chr(10), note_block, code_block, cut, case sources when 'rag' then 'answer from the passages' when 'graph' then 'answer from the structure' when 'graph+rag' then 'answer from passages and structure' end) else '' end as context
from sw left join bn using (query_id) left join bc using (query_id) left join gg using (query_id)""")
def routed_context(spark, sf_dir):
    """Every benchmark question from its route to the text that a model is given.

    Documents are the notes; those that have a part's number are its passage of code as well. Each fifth question has
    each setting of the mode. Where only graphs are used, their best connected symbols stand for passages: that block is
    the same for all such questions and is made once.
    """
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.expr(_SETTING).alias("setting"))
    routes = checkpointed(context.routed(asked))
    symbols = graphs.code_chunks(spark, sf_dir).withColumnRenamed("chunk_id", "doc_id")
    searched = routes.filter("use_notes or use_code").select("query_id", "text")
    found = checkpointed(search.hits(spark, sf_dir, searched, symbols.select("doc_id")).join(routes.select("query_id", "mode", "use_notes", "use_code", "use_graph"), "query_id"))
    notes = found.filter("collection = 'notes' and use_notes").withColumns({"title": F.concat_ws("/", "source", F.col("doc_id").cast("string")), "section": F.col("lang")})
    code = found.filter("collection = 'code' and use_code").join(graph.keyed(symbols), "doc_id").withColumn("section", F.col("section_header"))
    # Fetched passages in the graphs, with the tokens that a graph has beside them.
    shares = context.with_budgets(routes, notes, code, BUDGET, F.lit(True)).filter("use_graph").select("query_id", F.col("share.graph").alias("budget"))
    place = lambda repo, rank: F.struct(repo.alias("repo"), rank.cast("int").alias("place")).alias("rank")
    chunks = code.join(shares, "query_id").select(F.col("query_id").cast("string").alias("query_id"), F.col("doc_id").alias("chunk_id"), "repo", "source_path", "section_header", place(F.lit(""), F.col("rank")), "budget")
    alone = graphs.graph_only(spark, sf_dir).join(graph.keyed(graphs.nodes(spark, sf_dir).select("repo", "id", "ord")), ["repo", "id"])
    alone = alone.select(F.lit("all").alias("query_id"), (-1 - F.col("ord")).alias("chunk_id"), "repo", F.col("source_file").alias("source_path"), F.col("label").alias("section_header"), place(F.col("repo"), F.col("rank")), F.lit(BUDGET).alias("budget"))
    told = graph.structural_context(chunks.unionByName(alone), graphs.nodes(spark, sf_dir), graphs.edges(spark, sf_dir), graphs.summaries(spark, sf_dir), graphs.gods(spark, sf_dir))
    blocks = checkpointed(context.joined(told, ["query_id"], "rank", "block", "\n\n").select(F.col("query_id").alias("key"), F.col("block").alias("graph")))
    keyed = routes.filter("use_graph").select("query_id", F.when(F.col("use_code"), F.col("query_id").cast("string")).otherwise("all").alias("key"))
    return context.assembled(routes, notes, code, keyed.join(blocks, "key").select("query_id", "graph"), BUDGET)
