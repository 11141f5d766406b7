"""Queries of manifests and incremental change: two snapshots are made of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import manifest, ranking
from gleaner.plans.registry import query, table

_PATH = "source || '/' || doc_id || '.md'"
#: The manifest lacks some documents, knows others by another time, size or content, and has some that are gone.
_KNOWN = {"mtime": "case when doc_id % 7 = 1 then 1.5 else 2.5 end", "size": "n_chars + case when doc_id % 11 = 2 then 1 else 0 end", "sha256": "case when doc_id % 13 = 3 then 'x' else substr({sha}, 1, 16) end"}


def files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("doc_id % 17 <> 5")
    return docs.select(F.expr(_PATH).alias("path"), F.lit(2.5).cast("double").alias("mtime"), F.col("n_chars").alias("size"), F.expr("substr(sha2(text, 256), 1, 16)").alias("sha256"))


def known(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("doc_id % 5 <> 4")
    fields = {k: F.expr(v.replace("{sha}", "sha2(text, 256)")) for k, v in _KNOWN.items()}
    return docs.select(F.expr(_PATH).alias("path"), "source", "doc_id", fields["mtime"].cast("double").alias("mtime"), fields["size"].cast("bigint").alias("size"), fields["sha256"].alias("sha256"))


_SNAPSHOTS = f"""f as (select {_PATH} as path, 2.5::double as mtime, n_chars as size, substr(sha256(text), 1, 16) as sha256 from documents where doc_id % 17 <> 5),
k as (select {_PATH} as path, source, doc_id, ({_KNOWN["mtime"]})::double as mtime, ({_KNOWN["size"]})::bigint as size, {_KNOWN["sha256"].replace("{sha}", "sha256(text)")} as sha256 from documents where doc_id % 5 <> 4)"""


@query(f"with {_SNAPSHOTS} select * from (select f.*, case when k.path is null then 'new' when f.mtime is distinct from k.mtime then 'mtime' when f.size is distinct from k.size then 'size' when f.sha256 is distinct from k.sha256 then 'sha256' end as reason from f left join k on f.path = k.path) where reason is not null")
def needs_reindex(spark, sf_dir):
    return manifest.needs_reindex(files(spark, sf_dir), known(spark, sf_dir))


@query(f"with {_SNAPSHOTS} select path, doc_id from k where path not in (select path from f) and (select count(*) from f) > 0")
def stale_chunks(spark, sf_dir):
    return manifest.stale(known(spark, sf_dir), files(spark, sf_dir), "path").select("path", "doc_id")


@query(f"""with {_SNAPSHOTS} select path, mtime, size, sha256 from f union all select path, mtime, size, sha256 from k where path not in (select path from f)""")
def manifest_upsert(spark, sf_dir):
    old = known(spark, sf_dir).select("path", "mtime", "size", "sha256")
    return manifest.upserted(old, files(spark, sf_dir).withColumn("ord", F.lit(0)), "path")


@query(f"""with {_SNAPSHOTS} select path, source, case when path in (select path from f) then 'embedded' else 'pending' end as vector_status from k where source <> 'src3' union all select path, 'src3', 'replaced' from f where path like 'src3/%'""")
def manifest_chunks(spark, sf_dir):
    """Chunks of one source are replaced, then those of listed files are marked."""
    old = known(spark, sf_dir).select("path", "source", F.lit("pending").alias("vector_status"))
    new = files(spark, sf_dir).filter("path like 'src3/%'").select("path", F.lit("src3").alias("source"), F.lit("replaced").alias("vector_status"))
    marked = manifest.marked(old, files(spark, sf_dir), "path", "vector_status", "embedded").select(*old.columns)
    return manifest.replaced(marked, new, "source")


@query(f"with {_SNAPSHOTS} select count(*) as files, count(distinct source) as repos, count(*) filter (where sha256 <> 'x') as embedded, sum(size)::bigint as bytes from k")
def manifest_stats(spark, sf_dir):
    return known(spark, sf_dir).agg(F.count(F.lit(1)).alias("files"), F.countDistinct("source").alias("repos"), F.count_if(F.col("sha256") != "x").alias("embedded"), F.sum("size").alias("bytes"))


@query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where event_type <> 'purchase') where n = 1")
def last_run(spark, sf_dir):
    """The latest run of each user that has not ended in a purchase: events stand for runs."""
    runs = table(spark, sf_dir, "events").filter("event_type <> 'purchase'").select("user_id", "event_id", "ts")
    return ranking.top_k(runs, ["user_id"], 1, F.desc("ts"), F.desc("event_id")).drop("rank")


@query(f"with {_SNAPSHOTS} select coalesce(k.path, f.path) as path, case when k.path is null then 'new' when f.path is null then 'deleted' when k.size <> f.size or f.mtime > k.mtime then 'changed' else 'same' end as change from k full join f on k.path = f.path")
def sync_diff(spark, sf_dir):
    """What an incremental copy does: copy new and changed files (other size or later time), delete what is gone."""
    differs = (F.col("before.size") != F.col("after.size")) | (F.col("after.mtime") > F.col("before.mtime"))
    return manifest.snapshot_changes(known(spark, sf_dir), files(spark, sf_dir), "path", differs)


_DETECTED = f"""{_SNAPSHOTS}, c as (select coalesce(k.path, f.path) as path, case when k.path is null then 'new' when f.path is null then 'deleted' when k.sha256 <> f.sha256 then 'changed' else 'same' end as change from k full join f on k.path = f.path),
d as (select split_part(path, '/', 1) as repo, bool_or(change <> 'same' and path like '%0.md') as code_changed, bool_or(change <> 'same' and path not like '%0.md') as docs_changed from c group by 1)"""


@query(f"with {_DETECTED} select * from d")
def detect_changes(spark, sf_dir):
    """Whether code or documents of each repository changed; paths that end in 0 stand for code."""
    changes = manifest.snapshot_changes(known(spark, sf_dir), files(spark, sf_dir), "path", F.col("before.sha256") != F.col("after.sha256"))
    code, moved = F.col("path").like("%0.md"), F.col("change") != "same"
    return changes.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("repo")).agg(F.bool_or(moved & code).alias("code_changed"), F.bool_or(moved & ~code).alias("docs_changed"))


@query(f"with {_DETECTED} select repo, case when repo = 'src1' or repo = 'src2' then 'extract' when repo = 'src4' or (not code_changed and not docs_changed) then 'skip' when code_changed and not docs_changed then 'update' else 'extract' end as decision from d")
def build_decision(spark, sf_dir):
    """One repository is forced, one has no graph yet, one isn't to be updated."""
    repo = F.col("repo")
    decided = manifest.build_decision(repo == "src1", repo != "src2", repo != "src4", F.col("code_changed"), F.col("docs_changed"))
    return detect_changes(spark, sf_dir).select("repo", decided.alias("decision"))


@query("select doc_id, substr(sha256(encode(text)[1:65536]), 1, 16) as sha256 from documents")
def file_hash(spark, sf_dir):
    """A file's hash covers its first 64 KiB."""
    content = F.substring(F.encode("text", "UTF-8"), 1, 65536)
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(content, 256), 1, 16).alias("sha256"))


@query("select label, count(*) as deleted from embeddings where vec_id in (select vec_id from embeddings where vec_id % 3 = 0) group by label")
def delete_ids(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    left = manifest.deleted(vectors, vectors.filter("vec_id % 3 = 0").select("vec_id"), "vec_id")
    return vectors.join(left.select("vec_id"), "vec_id", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("deleted"))


@query("select quality, count(*) as documents from labels where doc_id in (select doc_id from documents) group by quality")
def labelled_documents(spark, sf_dir):
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("quality").agg(F.count(F.lit(1)).alias("documents"))


@query("""select event_id as run_id, ts as started_at, case when event_type = 'purchase' then ts + interval 5 minute when event_type = 'click' then ts + interval 1 minute end as finished_at,
case event_type when 'purchase' then 'completed' when 'click' then 'failed' else 'running' end as status, case event_type when 'click' then 'stopped' end as error from events""")
def run_log(spark, sf_dir):
    """Runs that are started, of which some end: events stand for runs."""
    events = table(spark, sf_dir, "events")
    none = spark.createDataFrame([], "run_id long, started_at timestamp, finished_at timestamp, status string, error string")
    runs = manifest.started(none, events.select(F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("started_at")))
    end = lambda kind, wait, status, error: events.filter(F.col("event_type") == kind).select(F.col("event_id").alias("run_id"), (F.col("ts") + F.expr(f"interval {wait} minute")).cast("timestamp").alias("finished_at"), F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"))
    return manifest.finished(runs, end("purchase", 5, "completed", None).unionByName(end("click", 1, "failed", "stopped")))


@query(f"with {_SNAPSHOTS} select path from k where source = 'src1'")
def repo_ids(spark, sf_dir):
    return manifest.ids_of(known(spark, sf_dir), "path", source="src1")


@query("select doc_id from documents where lower(source) = 'src2'")
def vault_rows(spark, sf_dir):
    return manifest.of_vault(table(spark, sf_dir, "documents").withColumnRenamed("source", "source_name"), "SRC2").select("doc_id")
