"""One ingest with its counters, a file that fails, and the runs after it."""

from gleaner.operators import ingest
from gleaner.sources.store import Collection

BODY = "A sentence that is long enough to be kept as a passage. " * 2


def test_counters_of_runs(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "c"), key="chunk_id", buckets=8)
    schema = "path string, stem string, text string"
    files = [("a.md", "a", BODY), ("b.md", "b", f"# One\n{BODY}\n# Two\n{BODY}x"), ("c.md", "c", None), ("d.md", "d", "short")]
    seen = spark.createDataFrame([], "path string, sha256 string")
    got, errors, seen = ingest.ingested(spark.createDataFrame(files, schema), seen, store)
    told = {k: v for k, v in got.items() if k not in ("elapsed_seconds", "chars", "tokens")}
    assert told == {"files_scanned": 4, "files_parsed": 3, "files_skipped": 0, "errors": 1, "chunks_produced": 3, "chunks_embedded": 3, "chunks_stored": 3, "stale_deleted": 0}
    assert [tuple(r) for r in errors.collect()] == [("c.md", "no text could be read")] and store.count() == 3 and got["elapsed_seconds"] > 0 and got["chars"] > 300
    # b.md loses a section, c.md can be read now, a.md is as it was.
    files[1:3] = [("b.md", "b", f"# One\n{BODY}"), ("c.md", "c", BODY)]
    got, errors, seen = ingest.ingested(spark.createDataFrame(files, schema), seen, store)
    assert (got["files_parsed"], got["files_skipped"], got["errors"], got["chunks_produced"], got["stale_deleted"]) == (2, 2, 0, 2, 1)
    assert errors.isEmpty() and store.count() == 3 and seen.count() == 4
    got, _, _ = ingest.ingested(spark.createDataFrame(files, schema), seen, store)
    assert (got["files_parsed"], got["files_skipped"], got["chunks_stored"], got["stale_deleted"], got["chars"]) == (0, 4, 0, 0, 0) and store.count() == 3
