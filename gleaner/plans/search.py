"""Queries of dense, sparse and hybrid search and of what follows them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.functions import lexicons, text
from gleaner.functions.vectors import cosine
from gleaner.operators import ranking, sparse
from gleaner.operators.ordering import checkpoint_folder, checkpointed
from gleaner.plans.registry import SQL_BLANKS, query, sql_list, table
from gleaner.plans.scalar import COMPLEX as _COMPLEX

K = 10
#: Folders of stored indexes by application and input, with the state of the input's files that they were fitted to.
_STORED: dict[tuple[str, str], tuple[tuple, str]] = {}
#: The stated query set of batch searches: every vector whose id is divisible by this, against all vectors.
QUERY_STEP = 100
_COSINE = "round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6)"


def queried(vectors, condition="vec_id = 0"):
    return vectors.filter(condition).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))


def dense(spark, sf_dir, condition="vec_id = 0", where=None):
    vectors = table(spark, sf_dir, "embeddings")
    return ranking.dense_scores(vectors, queried(vectors, condition), where)


def dense_batch(spark, sf_dir, k):
    """The k best of all vectors, with their rank, for each of the stated query set."""
    vectors = table(spark, sf_dir, "embeddings")
    return ranking.dense_pairs(vectors, queried(vectors, f"vec_id % {QUERY_STEP} = 0"), k)


@query(f"select e.vec_id, {_COSINE} as score from embeddings e, embeddings q where q.vec_id = 0 order by score desc, e.vec_id limit {K}")
def topk_dense(spark, sf_dir):
    return dense(spark, sf_dir).orderBy(F.desc("score"), "vec_id").limit(K).select("vec_id", "score")


@query(f"select e.vec_id, {_COSINE} as score from embeddings e, embeddings q where q.vec_id = 0 and e.label = q.label order by score desc, e.vec_id limit {K}")
def topk_filtered(spark, sf_dir):
    return dense(spark, sf_dir, where=F.col("label") == F.col("query_label")).orderBy(F.desc("score"), "vec_id").limit(K).select("vec_id", "score")


@query(f"""select vec_id, 'repo' || label as repo_name, symbol_type, score from (select e.vec_id, e.label, e.vec_id % 3 as kind, case e.vec_id % 3 when 0 then 'function' when 1 then 'class' else 'method' end as symbol_type, {_COSINE} as score
from embeddings e, embeddings q where q.vec_id = 0 and e.label = q.label) where symbol_type = 'function' order by score desc, vec_id limit {K}""")
def code_query(spark, sf_dir):
    """Code passages of one repository and kind of symbol: both filters hold before the limit."""
    kinds = F.when(F.col("vec_id") % 3 == 0, "function").when(F.col("vec_id") % 3 == 1, "class").otherwise("method")
    code = table(spark, sf_dir, "embeddings").withColumns({"repo_name": F.concat(F.lit("repo"), F.col("label").cast("string")), "symbol_type": kinds})
    wanted = (F.col("repo_name") == F.concat(F.lit("repo"), F.col("query_label").cast("string"))) & (F.col("symbol_type") == "function")
    best = ranking.dense_scores(code, queried(code), wanted).orderBy(F.desc("score"), "vec_id").limit(K)
    return best.join(code.select("vec_id", "repo_name", "symbol_type"), "vec_id").select("vec_id", "repo_name", "symbol_type", "score")


@query(f"select * from (select e.vec_id, {_COSINE} as score from embeddings e, embeddings q where q.vec_id = 0 order by score desc, e.vec_id limit {K}) where score >= 0.2")
def min_score(spark, sf_dir):
    return topk_dense(spark, sf_dir).filter(F.col("score") >= 0.2)


_DENSE = f"""d as (select q.vec_id as query_id, e.vec_id, {_COSINE} as score from embeddings e, embeddings q where q.vec_id % {QUERY_STEP} = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from d)"""


@query(f"with {_DENSE} select query_id, vec_id, score, rank from r where rank <= {K}")
def topk_batch(spark, sf_dir):
    return dense_batch(spark, sf_dir, K)


def files_state(spark, path):
    """How many files a table has, and a sum over their names, sizes and times: contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return tuple(files.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("path", "length", "modificationTime"), 24))).first())


def bm25_parts(spark, sf_dir):
    """The inverted index of the documents, fitted and stored once an application and read by every query after that;
    when the table's files have changed it is fitted anew."""
    where, state = (spark.sparkContext.applicationId, sf_dir), files_state(spark, f"{sf_dir}/documents.parquet")
    if where not in _STORED or _STORED[where][0] != state:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        folder = f"{checkpoint_folder(spark)}/bm25-{uuid.uuid4().hex}"
        sparse.fitted(docs, "doc_id", text.tokenize(F.col("text")), folder)
        _STORED[where] = state, folder
    return sparse.loaded(spark, _STORED[where][1])


_BM25 = """t as (select doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9_]+')) as term from documents),
c as (select doc_id, term, count(*) as tf from t group by all), s as (select (select count(*) from documents) as n, (select count(*) from t) / (select count(*) from documents) as avgdl),
w as (select term, count(*) as df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) as idf from c, s group by term),
l as (select doc_id, sum(tf) as length from c group by 1),
x as (select doc_id, term, idf * tf * 2.5::double / (tf + 1.5::double * (1 - 0.75::double + 0.75::double * length / avgdl)) as weight from c join l using (doc_id) join w using (term), s)"""


@query(f"with {_BM25} select term, row_number() over (order by term) - 1 as term_index, df, round(idf, 6) as idf from w")
def bm25_vocab(spark, sf_dir):
    _, _, weights = bm25_parts(spark, sf_dir)
    return sparse.vocabulary(weights).select("term", "term_index", "df", F.round("idf", 6).alias("idf"))


@query(f"with {_BM25} select doc_id, term, round(weight, 6) as weight from x")
def bm25_vectors(spark, sf_dir):
    counts, stats, weights = bm25_parts(spark, sf_dir)
    return sparse.document_weights(counts, weights, stats, "doc_id").select("doc_id", "term", F.round("weight", 6).alias("weight"))


def bm25_best(spark, sf_dir, k):
    """The k best of all documents for each benchmark text; stop-words are dropped on the query side only."""
    counts, stats, weights = bm25_parts(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    terms = sparse.term_counts(asked, "query_id", text.tokenize(F.col("text"))).filter(~F.col("term").isin(lexicons.STOP_WORDS))
    index = sparse.document_weights(counts, weights, stats, "doc_id", terms.select("term"))
    return sparse.sparse_best(index, sparse.query_weights(terms, weights, "query_id"), "doc_id", "query_id", k)


_SPARSE = f"""{_BM25}, qt as (select item_id as query_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9_]+')) as term from benchmark),
qc as (select query_id, term, count(*) as tf from qt where not list_contains({sql_list(lexicons.STOP_WORDS)}, term) group by all),
qw as (select query_id, term, idf * tf * 2.5::double / (tf + 1.5::double) as query_weight from qc join w using (term)),
b as (select query_id, doc_id, round(sum(weight * query_weight), 6) as score from x join qw using (term) group by all),
br as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from b)"""


@query(f"with {_SPARSE} select query_id, doc_id, score, rank from br where rank <= {K}")
def bm25_topk(spark, sf_dir):
    return bm25_best(spark, sf_dir, K)


@query(f"""with {_SPARSE}, {_DENSE.replace("r as (", "dr as (", 1)}, u as (select query_id, vec_id as doc_id, rank from dr where rank <= {2 * K} union all select query_id, doc_id, rank from br where rank <= {2 * K}),
f as (select query_id, doc_id, round(sum(1.0::double / (2 + rank - 1)), 6) as score from u group by all), fr as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from f)
select query_id, doc_id, score, rank from fr where rank <= {K}""")
def hybrid_rrf(spark, sf_dir):
    """Lists of twice the wanted length from both sides; queries with one list only are ranked by it."""
    near = dense_batch(spark, sf_dir, 2 * K).withColumnRenamed("vec_id", "doc_id")
    worded = bm25_best(spark, sf_dir, 2 * K)
    return ranking.fused([near, worded], "query_id", "doc_id", K).select("query_id", "doc_id", "score", "rank")


#: So many are fetched for K wanted ones.
FETCHED = min(3 * K, 50)


def passages(spark, sf_dir):
    """The first passages of each question with their scores: vectors as passages, their labels as sources."""
    vectors = table(spark, sf_dir, "embeddings")
    return dense_batch(spark, sf_dir, FETCHED).drop("rank").join(vectors.select("vec_id", "label"), "vec_id").withColumn("chunk_index", F.expr("vec_id % 50"))


def scored(spark, sf_dir, finish, **kept):
    """What ``finish`` makes of all vectors with each of the stated query set: labels as sources, ``chunk_index`` as places."""
    vectors = table(spark, sf_dir, "embeddings")
    return ranking.dense_each(vectors.withColumn("chunk_index", F.expr("vec_id % 50")), queried(vectors, f"vec_id % {QUERY_STEP} = 0"), finish, **kept)


_PASSAGES = f"p as (select q.vec_id as query_id, e.vec_id, {_COSINE} as score, e.label, e.vec_id % 50 as chunk_index from embeddings e, embeddings q where q.vec_id % {QUERY_STEP} = 0)"


@query(f"with {_PASSAGES}, r as (select *, row_number() over (partition by query_id, label, chunk_index order by score desc, vec_id) as n from p) select query_id, label, chunk_index, vec_id, score from r where n = 1")
def dedup_best(spark, sf_dir):
    best = lambda found: ranking.dedup_best(found, ["query_id", "label", "chunk_index"], "score", "vec_id")
    return scored(spark, sf_dir, best, k=1, by=("label", "chunk_index")).select("query_id", "label", "chunk_index", "vec_id", "score")


@query(f"with {_PASSAGES} select query_id, vec_id, score from (select *, max(score) over (partition by query_id, label) as best from p) where score >= greatest(0.2::double, best * 0.75::double)")
def dyn_threshold(spark, sf_dir):
    # Groups whose best is under the threshold have no rows, so theirs need not be known.
    good = lambda found: ranking.above_dynamic_threshold(found, ["query_id", "label"], "score", least=0.2)
    return scored(spark, sf_dir, good, by=("label",), least=0.2).select("query_id", "vec_id", "score")


@query(f"""with {_PASSAGES}, g as (select query_id, label, count(score) as chunks, max(score) as best from p group by all)
select query_id, label, chunks, best, best >= 0.5::double and chunks >= 5 as accepted,
case when best < 0.5::double then printf('best score %.2f is below %.2f', best, 0.5::double) when chunks < 5 then printf('%d of at least %d', chunks, 5) end as reason from g""")
def relevance_gate(spark, sf_dir):
    gate = lambda found: ranking.relevance_gate(found, ["query_id", "label"], "score", count=5)
    return scored(spark, sf_dir, gate, by=("label",)).select("query_id", "label", "chunks", "best", "accepted", "reason")


@query("""with t as (select source, doc_id, n_chars, case when text = '' then 0 else greatest(1, floor(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) * 1.3::double)::int) end as tokens from documents),
r as (select *, row_number() over w as rank, sum(tokens) over w as used from t window w as (partition by source order by n_chars desc, doc_id rows unbounded preceding))
select source, doc_id, tokens, used::bigint as used from r where rank = 1 or used <= 4000""")
def budget_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", "text")
    return ranking.within_budget_spread(docs, ["source"], "text", 4000, F.desc("n_chars"), F.col("doc_id")).select("source", "doc_id", "tokens", "used")


@query("""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line_no, unnest(string_split(text, chr(10))) as line from documents),
t as (select *, case when line = '' then 0 else greatest(1, floor(len(regexp_extract_all(line, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) * 1.3::double)::int) end as tokens from l),
r as (select *, sum(tokens) over (partition by doc_id order by line_no rows unbounded preceding) as used from t)
select doc_id, rtrim(string_agg(line, chr(10) order by line_no), ' ' || chr(10) || chr(9) || chr(13)) as kept from r where line_no = 1 or used <= 100 group by doc_id""")
def budget_text(spark, sf_dir):
    """The first lines of each text up to 100 estimated tokens; the first line stays in any case."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    kept = ranking.within_budget(lines, ["doc_id"], "line", 100, F.col("line_no"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("doc_id").agg(F.rtrim(joined, F.lit(" \n\t\r")).alias("kept"))


@query(f"with {_PASSAGES}, b as (select query_id, label, vec_id, score, row_number() over (partition by query_id, label order by score desc, vec_id) as rank from p) select query_id, label, string_agg(printf('[%d / %d]  score=%.2f', label, vec_id, score), chr(10) order by rank) as block from b where rank <= 5 group by all")
def context_blocks(spark, sf_dir):
    first = lambda found: ranking.top_k(found, ["query_id", "label"], 5, F.desc("score"), F.col("vec_id"))
    line = F.concat(F.format_string("[%d / %d]  score=", F.col("label"), F.col("vec_id")), text.two_places(F.col("score")))
    return scored(spark, sf_dir, first, k=5, by=("label",)).groupBy("query_id", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))


@query("select conv_id, arg_max(text, turn) as question, max(turn) as turn from conversations where role = 'user' group by conv_id")
def last_user_msg(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return asked.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("turn"))


@query("""with q as (select conv_id, arg_max(text, turn) as question from conversations where role = 'user' group by conv_id), s as (select conv_id, min(turn) as first from conversations where role = 'system' group by conv_id)
select conv_id, turn, role, case when turn = first and role = 'system' then 'context for: ' || coalesce(question, '') || chr(10) || text else text end as text from conversations left join q using (conv_id) left join s using (conv_id)
union all select conv_id, -1, 'system', 'context for: ' || question from q where conv_id not in (select conv_id from s)""")
def inject_context(spark, sf_dir):
    """The context goes before the first system turn's text, or into a system turn of its own."""
    turns = table(spark, sf_dir, "conversations")
    asked = last_user_msg(spark, sf_dir).select("conv_id", F.concat(F.lit("context for: "), "question").alias("context"))
    first = turns.filter("role = 'system'").groupBy("conv_id").agg(F.min("turn").alias("first"))
    joined = turns.join(asked, "conv_id", "left").join(first, "conv_id", "left")
    told = F.when((F.col("turn") == F.col("first")) & (F.col("role") == "system"), F.concat(F.coalesce("context", F.lit("context for: ")), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    own = asked.join(first, "conv_id", "left_anti").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.col("context").alias("text"))
    return joined.select("conv_id", "turn", "role", told.alias("text")).unionByName(own)


def asked_variants(asked):
    """``query_id, variant, text``: each text as it is (0) and as its keywords (1), unless these are the text itself in
    lower case or have 3 characters at most."""
    words = text.keywords(F.col("text"))
    variants = F.array(F.struct(F.lit(0).alias("variant"), F.col("text")), F.when((words != F.btrim(F.lower("text"), F.lit(text.BLANKS))) & (F.length(words) > 3), F.struct(F.lit(1).alias("variant"), words.alias("text"))))
    return asked.select("query_id", F.explode(F.array_compact(variants)).alias("v")).select("query_id", "v.variant", "v.text")


def multi_strategy_scores(spark, sf_dir, asked=None, k=K):
    """Each benchmark text as it is and as its keywords, against the documents; of both the better score. A document that
    is among the k best of a question by it is so in the list that has it, so k of each list are all that counts."""
    counts, stats, weights = bm25_parts(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text") if asked is None else asked
    terms = asked_variants(asked).select("query_id", "variant", F.explode(text.tokenize(F.col("text"))).alias("term")).filter(~F.col("term").isin(lexicons.STOP_WORDS)).groupBy("query_id", "variant", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = checkpointed(terms.withColumn("asked", F.struct("query_id", "variant")).drop("query_id", "variant"))
    index = sparse.document_weights(counts, weights, stats, "doc_id", terms.select("term"))
    found = sparse.sparse_best(index, sparse.query_weights(terms, weights, "asked"), "doc_id", "asked", k)
    return found.groupBy("asked.query_id", "doc_id").agg(F.max("score").alias("score"))


@query(f"""with {_BM25}, k as (select item_id, text, list_filter(list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda v: trim(v, '.,!?:;"''()[]')), lambda v: v <> ''), lambda v: not list_contains({sql_list(lexicons.STOP_WORDS)}, v) and length(v) > 2) as k from benchmark),
a as (select item_id as query_id, 0 as variant, text from benchmark union all select item_id, 1, case when len(k) > 0 then array_to_string(k, ' ') else text end as t from k where t <> trim(lower(text), {SQL_BLANKS}) and length(t) > 3),
qt as (select query_id, variant, unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9_]+')) as term from a),
qw as (select query_id, variant, term, any_value(idf) * count(*) * 2.5::double / (count(*) + 1.5::double) as query_weight from qt join w using (term) where not list_contains({sql_list(lexicons.STOP_WORDS)}, term) group by all),
b as (select query_id, variant, doc_id, round(sum(weight * query_weight), 6) as score from x join qw using (term) group by all), m as (select query_id, doc_id, max(score) as score from b group by all)
select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from m) where rank <= {K}""")
def multi_strategy(spark, sf_dir):
    return ranking.top_k(multi_strategy_scores(spark, sf_dir), ["query_id"], K, F.desc("score"), F.col("doc_id"))


@query("select label, count(*) as chunks, round(avg(list_cosine_similarity(embedding::double[], embedding::double[])), 6) as self_score from embeddings group by label")
def repo_stats(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.groupBy("label").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(cosine(F.col("embedding"), F.col("embedding"), 15)), 6).alias("self_score"))


@query("select vec_id from embeddings")
def existing_ids(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id")


_BOUNDS = "k as (select query_id, case when size <= 1000 then k else greatest(3, least(30, floor(k * (1 + log10(size / 1000)))::int)) end as k from (select item_id as query_id, case {kind} when 'simple' then 3 when 'complex' then 20 else 10 end as k, (select count(*) from documents) as size from benchmark))"


#: The scores of each question, as it is and as its keywords, by words (b) and by vectors (d).
ASKED_LISTS = f"""{_BM25}, {_BOUNDS.replace("{kind}", _COMPLEX)},
kw as (select item_id, text, list_filter(list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda v: trim(v, '.,!?:;"''()[]')), lambda v: v <> ''), lambda v: not list_contains({sql_list(lexicons.STOP_WORDS)}, v) and length(v) > 2) as k from benchmark),
a as (select item_id as query_id, 0 as variant, text from benchmark union all select item_id, 1, t from (select item_id, text, case when len(k) > 0 then array_to_string(k, ' ') else text end as t from kw) where t <> trim(lower(text), {SQL_BLANKS}) and length(t) > 3),
qt as (select query_id, variant, unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9_]+')) as term from a), qc as (select query_id, variant, term, count(*) as tf from qt where not list_contains({sql_list(lexicons.STOP_WORDS)}, term) group by all),
qw as (select query_id, variant, term, idf * tf * 2.5::double / (tf + 1.5::double) as query_weight from qc join w using (term)),
b as (select query_id, variant, doc_id, round(sum(weight * query_weight), 6) as score from x join qw using (term) group by all),
d as (select q.vec_id as query_id, 0 as variant, e.vec_id as doc_id, {_COSINE} as score from embeddings e, embeddings q where q.vec_id in (select item_id from benchmark))"""


@query(f"""with {ASKED_LISTS},
u as (select *, row_number() over (partition by query_id, variant, side order by score desc, doc_id) as rank from (select *, 'b' as side from b union all select *, 'd' from d)),
f as (select query_id, variant, doc_id, round(sum(1.0::double / (2 + rank - 1)), 6) as score from u join k using (query_id) where rank <= 2 * least(3 * k, 50) group by all),
h as (select * from (select *, row_number() over (partition by query_id, variant order by score desc, doc_id) as rank from f) join k using (query_id) where rank <= least(3 * k, 50)),
m as (select query_id, doc_id, any_value(k) as k, max(score) as score from h group by query_id, doc_id),
lt as (select m.*, source, text, list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda x: trim(x, {SQL_BLANKS})), lambda x: x <> '') as lines from m join documents using (doc_id)),
na as (select * from lt where len(lines) > 0 and len(list_filter(lines, lambda x: contains(x, '[[') and contains(x, ']]') and length(x) < 80)) / len(lines) <= 0.6),
th as (select * from (select *, max(score) over (partition by query_id) as best from na) where score >= greatest(0.45::double, best * 0.75::double) and best >= 0.5::double),
ck as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from th) where rank <= k),
e as (select query_id, doc_id, score, source, case when text = '' then 0 else greatest(1, floor(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) * 1.3::double)::int) end as tokens from ck),
o as (select *, row_number() over v as rank, sum(tokens) over v as used from e window v as (partition by query_id order by score desc, doc_id rows unbounded preceding))
select query_id, doc_id, source, score, tokens, rank::int as rank from o where rank = 1 or used <= 4000""")
def retrieve(spark, sf_dir):
    """The flagship, for every benchmark question: how many results it wants; dense and sparse lists of the question, and a
    sparse list of its keywords, fused by rank; the best of each passage; no navigation; threshold, gate, token budget."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    first = hits(spark, sf_dir, asked).drop("collection")
    gate = ranking.relevance_gate(first, ["query_id"], "score").filter("accepted").select("query_id")
    kept = ranking.within_budget(first.drop("rank").join(gate, "query_id", "left_semi"), ["query_id"], "text", 4000, F.desc("score"), F.col("doc_id"))
    return kept.select("query_id", "doc_id", "source", "score", "tokens", "rank")


def hits(spark, sf_dir, asked, code=None):
    """``query_id, collection, doc_id, source, lang, text, score, rank``: the first passages of notes for each question
    (``query_id, text``), and of code where ``code`` (``doc_id``) tells which documents are that too. One index serves both."""
    size = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("size"))
    wanted = asked.crossJoin(F.broadcast(size)).select("query_id", text.scaled_k(text.adaptive_k(text.complexity(F.col("text")), K), F.col("size")).alias("k"))
    wanted = checkpointed(wanted.withColumn("more", F.least(3 * F.col("k"), F.lit(50))))
    counts, stats, weights = bm25_parts(spark, sf_dir)
    terms = sparse.term_counts(asked_variants(asked).withColumn("asked", F.struct("query_id", "variant")), "asked", text.tokenize(F.col("text"))).filter(~F.col("term").isin(lexicons.STOP_WORDS))
    terms = checkpointed(terms)
    worded = sparse.sparse_scores(sparse.document_weights(counts, weights, stats, "doc_id", terms.select("term")), sparse.query_weights(terms, weights, "asked"), "doc_id", "asked")
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.join(asked, F.col("vec_id") == F.col("query_id"), "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))

    def nearest(some, collection):
        found = ranking.dense_pairs(some, queries, 100).drop("rank")
        return found.select(F.struct(F.lit(collection).alias("collection"), "query_id", F.lit(0).alias("variant")).alias("asked"), F.col("vec_id").alias("doc_id"), "score")

    near, kinds = nearest(vectors, "notes"), F.array(F.lit("notes"))
    if code is not None:
        near = near.unionByName(nearest(vectors.join(code, F.col("vec_id") == F.col("doc_id"), "left_semi"), "code"))
        worded = worded.join(code.select("doc_id", F.lit(True).alias("is_code")), "doc_id", "left")
        kinds = F.when(F.col("is_code"), F.array(F.lit("notes"), F.lit("code"))).otherwise(kinds)
    worded = worded.withColumn("collection", F.explode(kinds)).select(F.struct("collection", "asked.query_id", "asked.variant").alias("asked"), "doc_id", "score")
    fused = ranking.fused([_first(found, wanted, 2 * F.col("more")) for found in (near, worded)], "asked", "doc_id", 50)
    best = _first(fused.drop("rank"), wanted, F.col("more")).groupBy("asked.collection", "asked.query_id", "doc_id").agg(F.max("score").alias("score"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    told = checkpointed(best.join(docs, "doc_id").filter((F.col("collection") == "code") | ~text.navigates(F.lit(""), F.col("text"))))
    good = ranking.above_dynamic_threshold(told, ["collection", "query_id"], "score")
    return ranking.top_k(good.join(wanted, "query_id"), ["collection", "query_id"], F.col("k"), F.desc("score"), F.col("doc_id")).drop("k", "more")


def _first(found, wanted, k):
    """The first rows of each variant of a question, as many as the question wants."""
    sized = found.withColumn("query_id", F.col("asked.query_id")).join(F.broadcast(wanted) if wanted.count() <= 100_000 else wanted, "query_id").withColumn("__k", k)
    return ranking.top_k(sized, ["asked"], F.col("__k"), F.desc("score"), F.col("doc_id")).select("asked", "doc_id", "score", "rank")
