"""Queries of knowledge graphs: parts are symbols, nations and suppliers stand for files, brands for communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import lexicons
from gleaner.operators import export, graph
from gleaner.operators.ranking import top_k
from gleaner.plans.registry import query, sql_list, table
from gleaner.sources.graph_json import parsed_nodes

#: Symbols are parts, in the file of their type and the community of their brand; the repository is their brand's first digit.
_NODE = {
    "repo": "'r' || substr(p_brand, 7, 1)", "id": "'p' || p_partkey", "label": "p_name || case p_partkey % 3 when 0 then '()' else '' end",
    "source_file": "case p_partkey % 5 when 0 then 'tests/' when 1 then 'pipeline/search/' else 'src/' end || replace(p_type, ' ', '_') || '.py'", "community": "substr(p_brand, 7)", "ord": "p_partkey",
}
#: Edges join the parts of an order's neighbouring lines in the same repository.
_RELATION = "case l_quantity % 4 when 0 then 'calls' when 1 then 'uses' when 2 then 'imports_from' else 'contains' end"


def nodes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(*(F.expr(e).alias(n) for n, e in _NODE.items()))


def edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.max("l_quantity").alias("l_quantity"))
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("part").alias("target_part"))
    symbol = nodes(spark, sf_dir).select(F.col("ord").alias("part"), "repo", F.col("id").alias("source"))
    other = symbol.select(F.col("part").alias("target_part"), F.col("repo").alias("target_repo"), F.col("source").alias("target"))
    joined = lines.join(after, ["l_orderkey", "l_linenumber"]).join(graph.keyed(symbol), "part").join(graph.keyed(other), "target_part").filter("repo = target_repo")
    return joined.select("repo", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), "source", "target", F.expr(_RELATION).alias("relation"), F.col("l_quantity").alias("weight"))


_NODES = "n as (select " + ", ".join(f"{e} as {k}" for k, e in _NODE.items()) + " from part)"
_GRAPH = f"""{_NODES}, li as (select l_orderkey, l_linenumber, min(l_partkey) as part, max(l_quantity) as l_quantity from lineitem group by all),
e as (select a.repo, x.l_orderkey * 8 + x.l_linenumber as ord, a.id as source, b.id as target, {_RELATION.replace("l_quantity", "x.l_quantity")} as relation, x.l_quantity as weight
from li x join li y on x.l_orderkey = y.l_orderkey and x.l_linenumber + 1 = y.l_linenumber join n a on a.ord = x.part join n b on b.ord = y.part where a.repo = b.repo)"""
_INNER = "i as (select e.*, a.community, a.label as a, b.label as b from e join n a on e.source = a.id join n b on e.target = b.id where a.community = b.community)"
_LARGE = "g as (select repo, community, count(*) as members from n group by all having count(*) >= 5)"
_BOTH = """w as (select repo, source as id, target as neighbor, relation, 'outgoing' as direction, ord from e union all select repo, target, source, relation, 'incoming', ord from e where source <> target),
f as (select repo, id, neighbor, arg_min(relation, ord) as relation, arg_min(direction, ord) as direction, min(ord) as ord from w group by all),
v as (select *, row_number() over (partition by repo, id order by ord, neighbor)::int as rank from f)"""


_COUNTS = """c as (select x.repo, x.nodes, coalesce(y.edges, 0) as edges, coalesce(z.communities, 0) as communities from (select repo, count(*) as nodes from n group by repo) x
left join (select repo, count(*) as edges from e group by repo) y using (repo) left join (select repo, count(*) as communities from g group by repo) z using (repo))"""
_ODD = """od as (select * from (select e.repo, row_number() over (partition by e.repo order by weight desc, e.ord)::int as surprise_id, a.label as source, b.label as target, relation, 'joins ' || a.community || ' and ' || b.community as why, a.source_file as sf, b.source_file as tf
from e join n a on e.source = a.id join n b on e.target = b.id where a.community <> b.community) where surprise_id <= 5)"""
#: When the notes of these queries say that they were made.
MADE_AT = "2024-01-01T00:00:00Z"


def _front(column: str) -> str:
    """A string in front matter, in SQL."""
    return f"case when translate({column}, '{export.QUOTED_FOR}', '') <> {column} then '\"' || {column} || '\"' else {column} end"


@query(f"with {_GRAPH}, w as (select repo, source as id from e union all select repo, target from e) select n.repo, n.id, n.community, count(*) as degree from w join n using (repo, id) group by all")
def graph_degree(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir), nodes(spark, sf_dir))


@query(f"with {_GRAPH}, {_INNER} select repo, community, ord, source, target, relation from i")
def community_edges(spark, sf_dir):
    return graph.internal_edges(edges(spark, sf_dir), nodes(spark, sf_dir)).select("repo", "community", "ord", "source", "target", "relation")


@query(f"with {_GRAPH}, {_INNER} select repo, community, source, target, weight, rank from (select *, row_number() over (partition by repo, community order by weight desc, ord)::int as rank from i) where rank <= 10")
def top_edges(spark, sf_dir):
    return graph.top_edges(edges(spark, sf_dir), nodes(spark, sf_dir), 10).select("repo", "community", "source", "target", "weight", "rank")


@query(f"with {_GRAPH}, {_BOTH} select v.repo, v.id, neighbor, coalesce(n.label, neighbor) as neighbor_label, relation, direction, rank from v left join n on v.neighbor = n.id where rank <= 10")
def graph_neighbors(spark, sf_dir):
    return graph.neighbors(edges(spark, sf_dir), nodes(spark, sf_dir)).select("repo", "id", "neighbor", "neighbor_label", "relation", "direction", "rank")


@query(f"""with {_GRAPH}, q as (select distinct lower(p_brand) as wanted from part union select lower(p_name) from part where p_partkey % 100 = 0),
m as (select wanted, arg_min(id, ord) as id, arg_min(repo, ord) as repo from n, q where contains(lower(label), wanted) or contains(wanted, lower(label)) group by wanted), {_BOTH}
select wanted, m.id, neighbor, relation, direction from m join v on m.repo = v.repo and m.id = v.id where rank <= 10""")
def graph_neighbors_label(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    wanted = parts.select(F.lower("p_brand").alias("wanted")).union(parts.filter("p_partkey % 100 = 0").select(F.lower("p_name"))).distinct()
    found = graph.find_by_label(nodes(spark, sf_dir), wanted)
    return found.join(graph.neighbors(edges(spark, sf_dir), nodes(spark, sf_dir)), ["repo", "id"]).select("wanted", "id", "neighbor", "relation", "direction")


@query(f"""with {_NODES}, {_LARGE}, f as (select distinct repo, community, source_file from n join g using (repo, community) where source_file <> '')
select a.repo, a.community, b.community as other, array_to_string(list_sort(list(distinct a.source_file)), ',') as shared_files, count(distinct a.source_file)::int as shared_count
from f a join f b on a.repo = b.repo and a.source_file = b.source_file and a.community <> b.community group by all""")
def cross_links(spark, sf_dir):
    return graph.cross_links(nodes(spark, sf_dir)).withColumn("shared_files", F.array_join("shared_files", ","))


@query(f"""with {_NODES}, {_LARGE}, k as (select n.* from n join g using (repo, community) where source_file <> ''), c as (select repo, community, source_file, count(*) as symbols, min(ord) as ord from k group by all),
r as (select *, row_number() over (partition by repo, community order by symbols desc, ord)::int as rank from c), s as (select *, row_number() over (partition by repo, community, source_file order by ord) as p from k)
select r.repo, r.community, r.source_file, symbols, rank, string_agg(label, ', ' order by s.ord) || case when any_value(symbols) > 5 then ' (+' || (any_value(symbols) - 5) || ')' else '' end as listed
from r join s on r.repo = s.repo and r.community = s.community and r.source_file = s.source_file where rank <= 10 and p <= 5 group by all""")
def community_files(spark, sf_dir):
    return graph.community_files(nodes(spark, sf_dir))


@query(f"""with {_NODES}, {_LARGE}, p as (select unnest({sql_list(x for x, _ in lexicons.PATH_TAGS)}) as pattern, unnest({sql_list(x for _, x in lexicons.PATH_TAGS)}) as tag),
t as (select distinct repo, community, tag from n join p on contains(source_file, pattern)) select repo, community, coalesce(string_agg(tag, ',' order by tag), '') as tags from g left join t using (repo, community) group by all""")
def community_tags(spark, sf_dir):
    return graph.community_tags(nodes(spark, sf_dir)).withColumn("tags", F.array_join("tags", ","))


@query(f"with {_NODES}, s as (select distinct repo, 's' || (ord % 50) as surprise_id, source_file from n where ord % 10 = 0) select distinct n.repo, community, surprise_id from s join n on n.repo = s.repo and n.source_file = s.source_file")
def community_surprises(spark, sf_dir):
    found = nodes(spark, sf_dir)
    told = found.filter("ord % 10 = 0").groupBy("repo", F.concat(F.lit("s"), (F.col("ord") % 50).cast("string")).alias("surprise_id")).agg(F.collect_set("source_file").alias("source_files"))
    return graph.community_surprises(told, found)


_DIAGRAM = f"""with t as (select *, row_number() over (partition by repo, community order by weight desc, ord) as rank, count(*) over (partition by repo, community) as all_of from i where relation in {lexicons.TOLD_RELATIONS})
select repo, community, 'graph LR' || chr(10) || string_agg('    ' || regexp_replace(a, '[^a-zA-Z0-9_]', '_', 'g') || '["' || a || '"] ' || case relation when 'calls' then '-->' else '--' || relation || '-->' end || ' ' || regexp_replace(b, '[^a-zA-Z0-9_]', '_', 'g') || '["' || b || '"]', chr(10) order by rank) as diagram
from t where rank <= 12 and all_of >= 3 group by all"""


@query(f"with {_GRAPH}, {_INNER} select * from ({_DIAGRAM})")
def mermaid(spark, sf_dir):
    return graph.diagrams(edges(spark, sf_dir), nodes(spark, sf_dir))


#: Passages of code: a symbol's label and file as a chunker would tell them, some under another path or name.
_CHUNK = {
    "chunk_id": "p_partkey", "repo": _NODE["repo"], "source_path": f"case p_partkey % 4 when 1 then 'app/' else '' end || {_NODE['source_file']}",
    "section_header": "case p_partkey % 6 when 4 then substr(p_name, 1, 6) when 5 then upper(p_name) || ' (parte 2)' else p_name end",
}


def code_chunks(spark, sf_dir):
    return table(spark, sf_dir, "part").select(*(F.expr(e).alias(n) for n, e in _CHUNK.items()))


_NORM = "ltrim(rtrim(regexp_replace(regexp_replace(lower(trim({}, ' ')), '\\s*\\(parte\\s+[0-9]+\\)$', ''), '\\s*\\(module-level\\)$', ''), '()'), '.')"


@query(f"""with {_NODES}, x as (select repo, source_file, {_NORM.format("label")} as norm, arg_max(id, ord) as id, min(ord) as ord from n group by all),
c as (select {", ".join(f"{e} as {k}" for k, e in _CHUNK.items())} from part), d as (select *, {_NORM.format("section_header")} as asked from c),
m as (select chunk_id, id, ord, case when source_path = source_file and norm = asked then 1 when norm = asked then 2 else 3 end as tier from d join x on d.repo = x.repo
where (ends_with(source_path, source_file) or ends_with(source_file, source_path)) and (norm = asked or contains(norm, asked) or contains(asked, norm)))
select chunk_id, arg_min(id, tier::bigint * 1000000000 + ord) as id, min(tier)::int as tier from m group by chunk_id""")
def chunk_node_match(spark, sf_dir):
    return graph.match_chunks(code_chunks(spark, sf_dir), nodes(spark, sf_dir))


@query(f"""with {_GRAPH}, k as (select repo, relation, count(*) as c from e group by all), t as (select repo, sum(c)::bigint as edges, string_agg(relation || ': ' || c, ', ' order by c desc, relation) as relations from k group by repo)
select repo, count(*) as nodes, count(distinct community) as communities, coalesce(any_value(edges), 0) as edges, any_value(relations) as relations from n left join t using (repo) group by repo""")
def graph_report(spark, sf_dir):
    return graph.graph_report(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"with {_GRAPH} select repo, (select count(*) from n where n.repo = x.repo) as nodes, (select count(*) from e where e.repo = x.repo) as edges from (select distinct repo from n) x")
def graph_stats(spark, sf_dir):
    return graph.graph_report(nodes(spark, sf_dir), edges(spark, sf_dir)).select("repo", "nodes", "edges")


@query(f"""with recursive {_GRAPH}, l as materialized (select distinct source as id, target as next from e union select distinct target, source from e),
s as (select repo, 'p' || min(ord) as start from n group by repo), p(start, id, steps) using key (start, id) as (select start, start, 0 from s
union select p.start, l.next, any_value(p.steps) + 1 from p join l on p.id = l.id left join recurring.p v on v.start = p.start and v.id = l.next where v.id is null group by p.start, l.next)
select start, id, steps from p""")
def shortest_path(spark, sf_dir):
    """From the first symbol of each repository to every symbol that it reaches."""
    starts = nodes(spark, sf_dir).groupBy("repo").agg(F.concat(F.lit("p"), F.min("ord").cast("string")).alias("start")).select("start")
    return graph.shortest_paths(edges(spark, sf_dir), starts)


def path_questions(spark, sf_dir):
    """From one symbol in a hundred to the third one after it: named as users do, by a part of the label."""
    ends = nodes(spark, sf_dir).select("repo", "ord", F.upper("label").alias("label"))
    after = ends.select((F.col("ord") - 3).alias("ord"), F.expr("substring(label, 3)").alias("target_label"))
    return ends.filter("ord % 100 = 0").join(after, "ord").select("repo", F.col("label").alias("source_label"), "target_label")


@query(f"""with recursive {_GRAPH}, l as materialized (select distinct x.id, n.ord as next, x.repo from (select repo, source as id, target as next from e union select repo, target, source from e) x join n on n.repo = x.repo and n.id = x.next),
a as (select distinct x.repo, upper(x.label) as source_label, substring(upper(y.label), 3) as target_label from n x join n y on y.ord = x.ord + 3 where x.ord % 100 = 0),
f as materialized (select a.*, (select min(ord) from n where n.repo = a.repo and contains(lower(n.label), lower(source_label))) as source, (select min(ord) from n where n.repo = a.repo and contains(lower(n.label), lower(target_label))) as target from a),
g as materialized (select l.repo, n.ord, l.next from l join n on n.repo = l.repo and n.id = l.id),
p(repo, source, ord, path) using key (repo, source, ord) as (select distinct repo, source, source, [source] from f where source is not null and target is not null
union select p.repo, p.source, g.next, min(list_append(p.path, g.next)) from p join g on g.repo = p.repo and g.ord = p.ord left join recurring.p v on v.repo = p.repo and v.source = p.source and v.ord = g.next where v.ord is null group by p.repo, p.source, g.next),
x as (select f.repo, source_label, target_label, p.path from f left join p on p.repo = f.repo and p.source = f.source and p.ord = f.target),
t as (select repo, source_label, target_label, unnest(path) as ord, generate_subscripts(path, 1) as at from x)
select x.repo, x.source_label, x.target_label, coalesce((select string_agg(n.label, ' > ' order by t.at) from t join n on n.repo = t.repo and n.ord = t.ord where t.repo = x.repo and t.source_label = x.source_label and t.target_label = x.target_label), '') as path from x""")
def path_labels(spark, sf_dir):
    """The labels on the shortest path between two symbols that are named by parts of their labels."""
    found = graph.label_paths(edges(spark, sf_dir), nodes(spark, sf_dir), path_questions(spark, sf_dir))
    return found.withColumn("path", F.array_join("path", " > "))


def gods(spark, sf_dir):
    """The five best connected symbols of each repository."""
    degrees = graph.degrees(edges(spark, sf_dir), nodes(spark, sf_dir)).join(graph.keyed(nodes(spark, sf_dir).select("repo", "id", "ord")), ["repo", "id"])
    return top_k(degrees, ["repo"], 5, F.desc("degree"), F.col("ord")).select("repo", "id", "degree", "rank")


def summaries(spark, sf_dir):
    return graph.large_communities(nodes(spark, sf_dir)).select("repo", "community", F.concat(F.lit("about "), "community", F.lit(" with "), F.col("members").cast("string")).alias("summary"))


@query(f"""with {_GRAPH}, w as (select repo, source as id from e union all select repo, target from e), d as (select repo, id, count(*) as degree from w group by all),
r as (select d.*, n.label, n.source_file, row_number() over (partition by d.repo order by degree desc, ord)::int as rank from d join n using (repo, id)) select repo, id, label, source_file, 0.5::double as score, rank from r where rank <= 5""")
def graph_only(spark, sf_dir):
    """Without passages, the best connected symbols of each repository with summaries stand for them."""
    best = gods(spark, sf_dir).join(graph.keyed(nodes(spark, sf_dir).select("repo", "id", "label", "source_file")), ["repo", "id"]).join(summaries(spark, sf_dir).select("repo").distinct(), "repo", "left_semi")
    return best.select("repo", "id", "label", "source_file", F.lit(0.5).alias("score"), "rank")


@query(f"""with {_GRAPH}, w as (select repo, source as id from e union all select repo, target from e), d as (select repo, id, count(*) as degree from w group by all),
g as (select d.*, n.label, n.source_file, n.community, n.ord, row_number() over (partition by d.repo order by degree desc, ord) as rank from d join n using (repo, id)),
b as (select repo, source as id, target as other, relation, 'out' as way, ord from e union all select repo, target, source, relation, 'in', ord from e where source <> target),
r as (select b.*, coalesce(n.label, other) as name, row_number() over (partition by b.repo, b.id, way order by b.ord, other) as rank from b left join n on b.repo = n.repo and b.other = n.id),
t as (select repo, id, string_agg('- `' || name || '` ← ' || relation, chr(10) order by rank) filter (where way = 'out') as o, string_agg('- `' || name || '` → ' || relation, chr(10) order by rank) filter (where way = 'in') as i from r where rank <= 15 group by all)
select g.repo, g.id, g.repo || '/nodes/' || regexp_replace(replace(replace(label, '|', '-'), '/', '_'), '[\\[\\]#]', '', 'g') || '.md' as path, '---' || chr(10) || 'repo: ' || g.repo || chr(10) || 'symbol: ' || {_front("label")} || chr(10) || 'source_file: ' || {_front("source_file")} || chr(10) || 'degree: ' || degree || chr(10) || 'community: ' || community || chr(10)
|| 'tags: [god-node]' || chr(10) || '---' || chr(10) || chr(10) || '# `' || label || '`' || chr(10) || chr(10) || '> [[../Overview]] | [[../Community-' || community || ']] | Degree: ' || degree || chr(10) || chr(10) || '**Ficheiro:** `' || source_file || '` L' || (ord % 90 + 1) || chr(10)
|| coalesce(chr(10) || '## Chamadas / Dependências (outgoing)' || chr(10) || chr(10) || o || chr(10), '') || coalesce(chr(10) || '## Usado por (incoming)' || chr(10) || chr(10) || i || chr(10), '') as note
from g left join t on g.repo = t.repo and g.id = t.id where g.rank <= 5""")
def node_notes(spark, sf_dir):
    """A Markdown note for each of the best connected symbols of each repository."""
    located = nodes(spark, sf_dir).withColumn("source_location", F.concat(F.lit("L"), (F.col("ord") % 90 + 1).cast("string")))
    return export.node_notes(gods(spark, sf_dir), located, edges(spark, sf_dir))


def surprises(spark, sf_dir):
    """The five heaviest edges between two communities of each repository."""
    side = lambda end: nodes(spark, sf_dir).select("repo", F.col("id").alias(end), F.col("label").alias(f"{end}_label"), F.col("source_file").alias(f"{end}_file"), F.col("community").alias(f"{end}_community"))
    across = edges(spark, sf_dir).join(graph.keyed(side("source")), ["repo", "source"]).join(graph.keyed(side("target")), ["repo", "target"]).filter("source_community <> target_community")
    best = top_k(across, ["repo"], 5, F.desc("weight"), F.col("ord"))
    why = F.concat(F.lit("joins "), "source_community", F.lit(" and "), "target_community")
    return best.select("repo", F.col("rank").alias("surprise_id"), F.col("source_label").alias("source"), F.col("target_label").alias("target"), "relation", why.alias("why"), F.array("source_file", "target_file").alias("source_files"))


def repositories(spark, sf_dir):
    found = nodes(spark, sf_dir).select("repo").distinct()
    return found.select("repo", F.concat(F.lit("/src/"), "repo").alias("source_path"), F.concat(F.lit("/out/"), "repo", F.lit("/graph-out/graph.json")).alias("graph_path"), F.lit(MADE_AT).alias("generated_at"))


@query(f"""with {_GRAPH}, {_INNER}, {_LARGE}, {_ODD}, p as (select unnest({sql_list(x for x, _ in lexicons.PATH_TAGS)}) as pattern, unnest({sql_list(x for _, x in lexicons.PATH_TAGS)}) as tag),
tg as (select repo, community, 'tags: [' || string_agg(distinct tag, ', ' order by tag) || ']' || chr(10) as t from n join p on contains(source_file, pattern) group by repo, community),
dg as (select repo, community, '## Fluxo de Chamadas' || chr(10) || chr(10) || '```mermaid' || chr(10) || diagram || chr(10) || '```' || chr(10) || chr(10) as t from ({_DIAGRAM})),
cf as (select distinct repo, community, source_file from n join g using (repo, community) where source_file <> ''),
cp as (select a.repo, a.community, b.community as other, list_sort(list(a.source_file)) as files from cf a join cf b on a.repo = b.repo and a.source_file = b.source_file and a.community <> b.community group by all),
ck as (select *, row_number() over (partition by repo, community order by len(files) desc, other::bigint) as rank from cp),
cl as (select repo, community, '## Comunidades Relacionadas' || chr(10) || chr(10) || string_agg('- [[Community-' || other || ']] — ' || len(files) || ' ficheiro(s) partilhado(s): ' || array_to_string(list_transform(files[1:3], lambda x: '`' || x || '`'), ', ') || case when len(files) > 3 then ' (+' || (len(files) - 3) || ')' else '' end, chr(10) order by rank) || chr(10) || chr(10) as t from ck where rank <= 5 group by repo, community),
sc as (select distinct o.repo, n.community, surprise_id, source, target, why from od o join n on n.repo = o.repo and n.source_file in (o.sf, o.tf)),
sp as (select repo, community, '## Conexões Surpreendentes' || chr(10) || chr(10) || string_agg('> [!tip] `' || source || '` → `' || target || '`' || chr(10) || '> ' || why || chr(10), chr(10) order by surprise_id) || chr(10) as t from sc group by repo, community),
mf as (select repo, community, source_file, string_agg('- ' || label, chr(10) order by label) as t from n join g using (repo, community) group by all),
mb as (select repo, community, string_agg('### `' || source_file || '`' || chr(10) || t || chr(10), chr(10) order by source_file) as t from mf group by repo, community)
select g.repo, g.community, g.repo || '/Community-' || g.community || '.md' as path, '---' || chr(10) || 'repo: ' || g.repo || chr(10) || 'community_id: ' || g.community || chr(10) || 'members_count: ' || members || chr(10) || coalesce(tg.t, '') || '---' || chr(10) || chr(10)
|| '# Community ' || g.community || ' — ' || g.repo || chr(10) || chr(10) || '> [[Overview]] | ' || members || ' membros' || chr(10) || chr(10) || '> [!abstract] Propósito' || chr(10) || '> about ' || g.community || ' with ' || members || chr(10) || chr(10)
|| coalesce(dg.t, '') || coalesce(cl.t, '') || coalesce(sp.t, '') || '## Membros por ficheiro' || chr(10) || chr(10) || coalesce(mb.t, '') as note
from g left join tg using (repo, community) left join dg using (repo, community) left join cl using (repo, community) left join sp using (repo, community) left join mb using (repo, community)""")
def community_notes(spark, sf_dir):
    """A Markdown note for each large community."""
    return export.community_notes(nodes(spark, sf_dir), edges(spark, sf_dir), summaries(spark, sf_dir), surprises(spark, sf_dir))


@query(f"""with {_GRAPH}, {_LARGE}, {_ODD}, {_COUNTS}, w as (select repo, source as id from e union all select repo, target from e), d as (select repo, id, count(*) as degree from w group by all),
r as (select d.*, n.label, n.source_file, row_number() over (partition by d.repo order by degree desc, ord) as rank from d join n using (repo, id)),
bs as (select repo, string_agg('| [[nodes/' || regexp_replace(replace(label, '|', '-'), '[\\[\\]#]', '', 'g') || chr(92) || '|' || label || ']] | `' || source_file || '` | ' || degree || ' |', chr(10) order by rank) as t from r where rank <= 5 group by repo),
os as (select repo, string_agg('### `' || source || '` → `' || target || '`' || chr(10) || '**Relação:** ' || relation || chr(10) || '**Ficheiros:** `' || sf || '`, `' || tf || '`' || chr(10) || '**Porquê:** ' || why || chr(10), chr(10) order by surprise_id) as t from od group by repo),
cs as (select repo, string_agg('- [[Community-' || community || ']]', chr(10) order by community::bigint) as t from g group by repo)
select c.repo, c.repo || '/Overview.md' as path, rtrim('---' || chr(10) || 'repo: ' || c.repo || chr(10) || 'source_path: /src/' || c.repo || chr(10) || 'graph_path: "/out/' || c.repo || '/graph-out/graph.json"' || chr(10) || 'generated_at: {MADE_AT}' || chr(10) || 'nodes: ' || nodes || chr(10) || 'edges: ' || edges || chr(10) || 'communities: ' || communities || chr(10) || '---' || chr(10) || chr(10)
|| '# ' || c.repo || ' — Knowledge Graph' || chr(10) || chr(10) || '> [!info] Projecto fonte' || chr(10) || '> **Path:** `/src/' || c.repo || '`' || chr(10) || '> **Grafo:** `/out/' || c.repo || '/graph-out/graph.json`' || chr(10) || '> **Gerado:** {MADE_AT}' || chr(10) || '> **Nodes:** ' || nodes || ' | **Edges:** ' || edges || chr(10) || chr(10)
|| coalesce('## God Nodes' || chr(10) || chr(10) || '> Nós mais conectados — prováveis pontos de entrada no código' || chr(10) || chr(10) || '| Símbolo | Ficheiro | Degree |' || chr(10) || '|---------|----------|--------|' || chr(10) || bs.t || chr(10) || chr(10), '')
|| coalesce('## Conexões Surpreendentes' || chr(10) || chr(10) || os.t || chr(10), '') || coalesce('## Comunidades' || chr(10) || chr(10) || '> Grupos de módulos fortemente relacionados (só comunidades com ≥ 5 membros)' || chr(10) || chr(10) || cs.t || chr(10), ''), chr(10)) || chr(10) as note
from c left join bs using (repo) left join os using (repo) left join cs using (repo)""")
def overview_notes(spark, sf_dir):
    """A Markdown overview of each repository."""
    return export.overview_notes(repositories(spark, sf_dir), nodes(spark, sf_dir), edges(spark, sf_dir), gods(spark, sf_dir), surprises(spark, sf_dir))


@query(f"""with {_GRAPH}, {_LARGE}, {_COUNTS}, w as (select repo, source as id from e union select repo, target from e), b as (select c.*, (select least(count(distinct id), 5) from w where w.repo = c.repo) as best from c)
select 'index.md' as path, '---' || chr(10) || 'generated_at: {MADE_AT}' || chr(10) || 'repos_count: ' || count(*) || chr(10) || 'tags: [knowledge-graph, rag, index]' || chr(10) || '---' || chr(10) || chr(10) || '# Knowledge Graphs — Índice' || chr(10) || chr(10) || '> Gerado em {MADE_AT}' || chr(10)
|| '> Vault dedicado à visualização estrutural de repositórios de código.' || chr(10) || chr(10) || '## Repositórios' || chr(10) || chr(10) || '| Repo | Nodes | Edges | Comunidades | God Nodes | Fonte | Actualizado |' || chr(10) || '|------|-------|-------|-------------|-----------|-------|-------------|' || chr(10)
|| string_agg('| [[' || repo || '/Overview' || chr(92) || '|' || repo || ']] | ' || nodes || ' | ' || edges || ' | ' || communities || ' | ' || best || ' | `/src/' || repo || '` | {MADE_AT} |' || chr(10), '' order by repo) || chr(10) || '## Navegação' || chr(10) || chr(10) || string_agg('- [[' || repo || '/Overview]]' || chr(10), '' order by repo) as note from b""")
def index_note(spark, sf_dir):
    """The note that lists all repositories."""
    return export.index_note(repositories(spark, sf_dir), nodes(spark, sf_dir), edges(spark, sf_dir), gods(spark, sf_dir), MADE_AT)


@query(f"""with {_GRAPH} select repo, id, label, source_file, community, ord from n""")
def graph_load(spark, sf_dir):
    """Nodes out of JSON documents of their repositories, here one document a node."""
    node = F.struct("id", "label", "source_file", "community", F.col("ord").cast("long").alias("ord"))
    return parsed_nodes(nodes(spark, sf_dir).select("repo", F.to_json(F.struct(F.array(node).alias("nodes"))).alias("document")))


@query(f"""with {_GRAPH}, {_LARGE}, {_INNER}, k as (select n.* from n join g using (repo, community) where source_file <> ''), c as (select repo, community, source_file, count(*) as symbols, min(ord) as ord from k group by all),
r as (select *, row_number() over (partition by repo, community order by symbols desc, ord) as rank from c), s as (select *, row_number() over (partition by repo, community, source_file order by ord) as p from k),
fl as (select r.repo, r.community, r.source_file, rank, string_agg(label, ', ' order by s.ord) || case when any_value(symbols) > 5 then ' (+' || (any_value(symbols) - 5) || ')' else '' end as listed from r join s on r.repo = s.repo and r.community = s.community and r.source_file = s.source_file where rank <= 10 and p <= 5 group by all),
ft as (select repo, community, string_agg('  ' || source_file || ': ' || listed, chr(10) order by rank) as files from fl group by all),
w as (select repo, source as id from e union all select repo, target from e), d as (select n.repo, n.community, n.label, n.ord, count(*) as degree from w join n using (repo, id) group by all),
dr as (select *, row_number() over (partition by repo, community order by degree desc, ord) as rank from d), dt as (select repo, community, string_agg('  ' || label || ' (degree ' || degree || ')', chr(10) order by rank) as symbols from dr where rank <= 5 group by all),
ir as (select *, row_number() over (partition by repo, community order by ord) as rank from i), it as (select repo, community, string_agg('  ' || a || ' --' || relation || '--> ' || b, chr(10) order by rank) as edges from ir where rank <= 10 group by all)
select g.repo, g.community, members, 'Community ' || g.community || ' of ' || g.repo || ', ' || members || ' members' || chr(10) || 'Files:' || chr(10) || coalesce(files, '  none') || chr(10) || 'Symbols:' || chr(10) || coalesce(symbols, '  none') || chr(10) || 'Edges:' || chr(10) || coalesce(edges, '  none') as prompt
from g left join ft using (repo, community) left join dt using (repo, community) left join it using (repo, community)""")
def community_prompt(spark, sf_dir):
    return graph.community_prompts(nodes(spark, sf_dir), edges(spark, sf_dir))
