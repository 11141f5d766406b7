"""The splitters against plain versions and fixtures."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.operators import chunking
from gleaner.sources.graph_json import read_graph
from gleaner.sources.files import scan_notes, scan_repo
from gleaner.sources.store import Collection

SOURCE = '''"""A module."""
import os

LIMIT = 3


@cached
def load(path):
    """Read a file and give back its lines, without the final line ends of each."""
    return open(path).read().splitlines()


class Store:
    """Keeps rows in the order in which they were put, for as long as it is open."""

    def put(self, row):
        self.rows.append(row)  # one more row is kept here until the store is emptied again
        return len(self.rows)
'''


@given(st.text(alphabet="ab. \n", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_split_covers_the_text_in_order(text, size, overlap):
    pieces = chunking.split_at(text, size, overlap)
    at = 0
    for p in pieces:
        found = text.find(p, max(0, at - overlap - 1)) if len(text) > size else 0
        assert found >= 0 and (len(p) <= size or len(text) <= size)
        at = found + len(p)
    assert "".join("".join(pieces).split()) if text.strip() else True


def test_split_ends_after_paragraphs_then_sentences():
    assert chunking.split_at("aaa. bbb\n\nccc ddd", 12, 0) == ["aaa. bbb", "ccc ddd"]
    assert chunking.split_at("aaa. bbb ccc", 10, 0) == ["aaa.", "bbb ccc"]
    assert chunking.split_at("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]


def test_split_lines_repeats_the_last_lines():
    assert chunking.split_lines("a\nb\nc\nd\n", 4, 2) == ["a\nb", "b\nc", "c\nd"]
    assert chunking.split_lines("x" * 9, 4, 2) == ["x" * 9]


def test_python_symbols():
    found = {n: (k, t) for n, k, t in chunking.python_symbols(SOURCE)}
    assert found["(module-level)"] == ("module", '"""A module."""\nimport os\nLIMIT = 3')
    assert found["load"][1].startswith("@cached\ndef load")
    assert found["class Store"][1].endswith("    def put(self, row):\n    ...")
    assert found["Store.put"][0] == "method"
    assert chunking.python_symbols("def (") is None


def test_chunk_code(spark):
    rows = chunking.chunk_code(spark.createDataFrame([("src/a.py", "r", SOURCE), ("b.rb", "r", "package b\n" * 300), ("m.go", "r", "package b\n" * 300), ("c.py", "r", "def ("), ("d.py", "r", " ")], "path string, repo_name string, source string")).collect()
    python = sorted((r["chunk_index"], r["symbol_type"], r["section_header"]) for r in rows if r["path"] == "src/a.py")
    assert python == [(0, "function", "load"), (1, "class", "class Store"), (2, "method", "Store.put")]
    assert [r["chunk_index"] for r in rows if r["path"] == "b.rb"] == [0, 1]
    assert [(r["chunk_index"], r["symbol_type"], r["section_header"]) for r in rows if r["path"] == "m.go"] == [(0, "module", "m.go (module-level)")]
    assert not [r for r in rows if r["path"] in ("c.py", "d.py")]
    assert all(r["embedding_text"].startswith(f"Repo: r | Ficheiro: {r['path']} | ") for r in rows)


def test_notes(spark, tmp_path):
    body = "A sentence that is long enough to be kept as a passage. " * 2
    (tmp_path / ".obsidian").mkdir()
    (tmp_path / ".obsidian" / "x.md").write_text(body)
    (tmp_path / "note.md").write_text(f"---\ntags: x\n---\n# Title\n\n{body}\n\n## Links\n\n- [[a]]\n- [[b]]\n\n## Long\n\n{body * 40}\n")
    notes = scan_notes(spark, str(tmp_path))
    assert [r["path"] for r in notes.collect()] == ["note.md"]
    rows = sorted(chunking.chunk_notes(notes).collect(), key=lambda r: (r["section_header"] != "Title", r["chunk_index"]))
    assert {r["section_header"] for r in rows} == {"Title", "Long"} and {r["note_title"] for r in rows} == {"Title"}
    assert rows[0]["embedding_text"] == f"Nota: Title | Secção: Title\n{body.strip()}"
    assert [r["chunk_index"] for r in rows[1:]] == list(range(len(rows) - 1)) and len(rows) > 3


def test_repository_scan(spark, tmp_path):
    for p in ("a.py", "venv/b.py", "docs/c.md", "x.bin"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    assert sorted(r["path"] for r in scan_repo(spark, str(tmp_path), "r").collect()) == ["a.py", "docs/c.md"]


def test_embedding_batches(spark):
    rows = spark.createDataFrame([(s, i, "x" * n) for s in "ab" for i, n in enumerate([3, 3, 9, 1, 1, 1, 1])], "s string, i int, t string")
    got = {(r["s"], r["i"]): r["batch"] for r in chunking.embedding_batches(rows, "s", "i", "t", rows=3, chars=10).collect()}
    assert [got["a", i] for i in range(7)] == [0, 0, 0, 1, 1, 1, 2] and all(got["a", i] == got["b", i] for i in range(7))


def test_batches_over_blocks(spark, monkeypatch):
    """A group over many blocks, batches that span them, empty and null texts: as one walk does it."""
    monkeypatch.setattr(chunking, "BATCH_BLOCK", 7)
    rng = random.Random(4)
    rows = [(s, i, None if rng.random() < 0.05 else "x" * rng.choice([0, 1, 3, 9, 40])) for s in ("a", "b", None) for i in range(60 if s == "a" else 9)]
    got = {(r["s"], r["i"]): r["batch"] for r in chunking.embedding_batches(spark.createDataFrame(rows, "s string, i int, t string"), "s", "i", "t", rows=5, chars=60).collect()}
    want = {}
    for s in ("a", "b", None):
        batch, count, total = 0, 0, 0
        for name, i, text in rows:
            if name == s:
                if count >= 5 or total >= 60:
                    batch, count, total = batch + 1, 0, 0
                count, total = count + 1, total + len(text or "")
                want[s, i] = batch
    assert got == want


def test_collection(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "c"))
    assert not store.healthy()
    rows = spark.createDataFrame([(i, "alpha" if i < 2 else "beta", f"t{i}") for i in range(5)], "id int, repo string, text string")
    store.upsert(rows)
    store.upsert(rows)
    assert store.count() == 5 and store.count(repo="alpha") == 2
    store.upsert(spark.createDataFrame([(0, "alpha", "new")], rows.schema))
    assert store.read().filter("id = 0").first()["text"] == "new"
    assert store.delete(spark.createDataFrame([(1,), (99,)], "id int")) == 2 and store.count() == 4
    assert store.healthy()


def test_graph_json(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "label": "A"}, {"id": "b"}], "links": [{"source": "a", "target": "b"}]}')
    nodes, edges = read_graph(spark, str(tmp_path / "g.json"), "r")
    assert [(r["id"], r["label"]) for r in nodes.orderBy("ord").collect()] == [("a", "A"), ("b", "")]
    assert edges.select("relation", "weight").first() == ("related_to", 1.0)
    (tmp_path / "bad.json").write_text("{not json")
    assert read_graph(spark, str(tmp_path / "bad.json"), "r")[0].count() == 0


@pytest.mark.parametrize("text", ["no header", "# A\n\nbody\n## B\n\n#### not one\nmore\n###   C\n"])
def test_sections(spark, text):
    got = [(r["header"], r["body"]) for r in chunking.header_sections(spark.createDataFrame([(text,)], "text string")).orderBy("section_index").collect()]
    assert got == ([("", "no header")] if text == "no header" else [("A", "body"), ("B", "#### not one\nmore")])


def test_whole_texts_are_not_gathered_in_arrow_batches(spark):
    docs = spark.createDataFrame([(1, "a. " * 900), (2, "b"), (3, None), (4, "c\n" * 1500)], "doc_id int, text string")
    for cut, plain in ((chunking.long_pieces, chunking.split_at), (chunking.line_pieces, chunking.split_lines)):
        df = docs.select("doc_id", cut(F.col("text")).alias("p"))
        assert "ArrowEvalPython" not in df._jdf.queryExecution().sparkPlan().toString()
        assert {r["doc_id"]: r["p"] for r in df.collect()} == {1: plain("a. " * 900, 2000, 200), 2: ["b"], 3: None, 4: plain("c\n" * 1500, 2000, 200)}
