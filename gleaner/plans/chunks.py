"""Queries of the chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import lexicons
from gleaner.functions.text import navigates
from gleaner.operators import chunking, embedding, ingest, symbols
from gleaner.operators.ordering import checkpointed
from gleaner.plans import registry
from gleaner.plans.registry import SQL_BLANKS, query, sql_list, table
from gleaner.sources.files import NOTE_DIRS, has_part


@query("""with recursive w as (select doc_id, text, length(text) as n, 0::bigint as pos from documents where length(text) > 2000
union all select doc_id, text, n, case when least(stop, n) - 200 > pos and stop < n then stop - 200 else stop end from (
  select doc_id, text, n, pos, case when pos + 2000 >= n then pos + 2000 else pos + case when strpos(reverse(substr(text, pos + 1, 2000)), ' .') > 0 and 2000 - strpos(reverse(substr(text, pos + 1, 2000)), ' .') - 1 > 0
    then 2000 - strpos(reverse(substr(text, pos + 1, 2000)), ' .') else 2000 end end as stop from w) where stop < n),
p as (select doc_id, pos, trim(substr(text, pos + 1, case when pos + 2000 >= n then 2000 when strpos(reverse(substr(text, pos + 1, 2000)), ' .') > 0 and 2000 - strpos(reverse(substr(text, pos + 1, 2000)), ' .') - 1 > 0
  then 2000 - strpos(reverse(substr(text, pos + 1, 2000)), ' .') else 2000 end), ' ' || chr(10) || chr(9) || chr(13)) as piece from w)
select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::int as chunk_index, piece from p where piece <> '' union all select doc_id, 0, text from documents where length(text) <= 2000""")
def split_long(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(chunking.long_pieces(F.col("text"))).alias("chunk_index", "piece"))


#: Notes made of documents: sentences end in headers of changing depth.
_NOTE = "case doc_id % 3 when 0 then text when 1 then '# ' || lang || chr(10) || text else '---' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) || text || chr(10) || '## ' || source || chr(10) || text || chr(10) || '#### no header' end"


@query(f"""with n as (select doc_id, regexp_replace({_NOTE}, '(^|\\n)(#{{1,3}})[ \\t]+([^\\n]+)', '\\1' || chr(1) || '\\3' || chr(1), 'g') as t from documents), s as (select doc_id, string_split(t, chr(1)) as p from n),
x as (select doc_id, unnest(range(0, len(p) // 2 + 1)) as i, p from s), y as (select doc_id, i::int as section_index, case when i = 0 then '' else trim(p[2 * i]) end as header, trim(p[2 * i + 1], ' ' || chr(10) || chr(9) || chr(13)) as body from x)
select doc_id, section_index, header, length(body)::int as chars from y where body <> ''""")
def header_sections(spark, sf_dir):
    notes = table(spark, sf_dir, "documents").select("doc_id", F.expr(_NOTE).alias("text"))
    return chunking.header_sections(notes).select("doc_id", "section_index", "header", F.length("body").alias("chars"))


def _sql_pieces(rows: str, keys: str) -> str:
    """The windows of long texts of ``rows`` (``keys``, text) as recursive SQL: ``keys, pos, piece``."""
    window = "substr(text, pos + 1, 2000)"
    stop = f"case when strpos(reverse({window}), ' .') > 0 and 2000 - strpos(reverse({window}), ' .') - 1 > 0 then 2000 - strpos(reverse({window}), ' .') else 2000 end"
    return f"""w as (select {keys}, text, length(text) as n, 0::bigint as pos from {rows} where length(text) > 2000
union all select {keys}, text, n, case when least(stop, n) - 200 > pos and stop < n then stop - 200 else stop end from (select {keys}, text, n, pos, case when pos + 2000 >= n then pos + 2000 else pos + {stop} end as stop from w) where stop < n),
p as (select {keys}, pos, trim(substr(text, pos + 1, case when pos + 2000 >= n then 2000 else {stop} end), ' ' || chr(10) || chr(9) || chr(13)) as piece from w union all select {keys}, 0, text from {rows} where length(text) <= 2000)"""


_BLANK = "' ' || chr(10) || chr(9) || chr(13)"


@query(f"""with recursive n as (select doc_id, source || '/' || doc_id || '.md' as path, trim(regexp_replace(trim({_NOTE}, {_BLANK}), '^---\\s*\\n(?s:.*?)\\n---\\s*\\n', ''), {_BLANK}) as t from documents),
h as (select *, case when regexp_extract(t, '^#\\s+([^\\n]+)', 1) <> '' then trim(regexp_extract(t, '^#\\s+([^\\n]+)', 1)) else doc_id::varchar end as title, string_split(regexp_replace(t, '(^|\\n)(#{{1,3}})[ \\t]+([^\\n]+)', '\\1' || chr(1) || '\\3' || chr(1), 'g'), chr(1)) as q from n where t <> ''),
x as (select *, unnest(range(0, len(q) // 2 + 1)) as i from h), s as (select path, title, i, case when i = 0 then '' else trim(q[2 * i]) end as header, trim(q[2 * i + 1], {_BLANK}) as text from x),
b as (select * from s where text <> ''), {_sql_pieces("b", "path, title, i, header")},
c as (select *, (row_number() over (partition by path, i order by pos) - 1)::int as chunk_index from p where piece <> '')
select path as source_path, title as note_title, header as section_header, chunk_index, piece as display_text, substr(sha256(path || ':' || header || ':' || chunk_index || ':' || piece), 1, 16) as chunk_id,
'Nota: ' || title || case when header <> '' then ' | Secção: ' || header else '' end || chr(10) || piece as embedding_text from c where length(trim(piece, {_BLANK})) >= 50""")
def chunk_notes(spark, sf_dir):
    """Notes through front matter, title, sections, link filter, windows and ids."""
    docs = table(spark, sf_dir, "documents")
    notes = docs.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("doc_id").cast("string").alias("stem"), F.expr(_NOTE).alias("text"))
    return chunking.chunk_notes(notes)


#: Sources made of documents: valid Python with the text in strings, and text in other languages.
_CODE = """case doc_id % 2 when 0 then 'import os' || chr(10) || 'TEXT = ' || to_json(named_struct('t', text)) || chr(10) || chr(10) || '@os.x' || chr(10) || 'def f(a):' || chr(10) || '    return ' || to_json(named_struct('t', substr(text, 1, 900))) || chr(10) || 'class C:' || chr(10) || '    "about"' || chr(10) || '    def m(self):' || chr(10) || '        return ' || to_json(named_struct('t', text)) || chr(10) else text end"""


@query()
def chunk_code(spark, sf_dir):
    """Tested against fixtures: SQL has no parser of Python."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".py").when(F.col("doc_id") % 4 == 1, ".go").otherwise(".rb"))
    return chunking.chunk_code(docs.select(path.alias("path"), F.col("source").alias("repo_name"), F.expr(_CODE).alias("source")))


#: Sources of nine languages made of documents, with braces in strings and comments.
_BRACES = {
    "js": r"""'import x from "y";\n\n/* { not open */\nfunction greet' || doc_id || '(name) {\n  // }\n  return "' || q || ' {";\n}\n\nexport class Box {\n  open(a) { return a; }\n}\nclass Store {\n  constructor(v) {\n    this.v = `' || q || '`;\n  }\n\n  static async load(x) {\n    return x;\n  }\n}\nconst size = 3;\n'""",
    "ts": r"""'interface User {\n  name: string;\n}\ntype Id = string;\nexport const late = "' || q || '";\nclass A {\n  private x: number = 1;\n  add(u: User): void {\n    this.x += 1;\n  }\n}\n'""",
    "java": r"""'package a.b;\n\nimport c.D;\n\n@Deprecated\npublic class Calc' || doc_id || '\n    extends Base\n{\n    private int v = f(1);\n\n    public Calc' || doc_id || '(int v) {\n        this.v = v;\n    }\n\n    @Override\n    public String text() {\n        return "' || q || '}";\n    }\n}\n'""",
    "go": r"""'package main\n\nimport "fmt"\n\nfunc (s *Server) Run' || doc_id || '(a int) string {\n\treturn "' || q || '"\n}\n\nfunc hello() {\n}\n\ntype Server struct {\n\tPort int\n}\n'""",
    "rs": r"""'use a::b;\n\n#[derive(Debug)]\npub struct Point {\n    x: f64,\n}\n\nimpl Show for Point {\n    pub fn text(&self) -> String {\n        let c = ' || chr(39) || '{' || chr(39) || ';\n        "' || q || '"\n    }\n}\n'""",
    "c": r"""'#include <a.h>\n\nstruct pair {\n    int a;\n};\n\nstatic int count = 3;\n\nint main(void)\n{\n    puts("' || q || '");\n}\ntypedef int number;\n'""",
    "cpp": r"""'#include <a>\nnamespace a {\nint f() { return 1; }\n}\ntemplate <typename T>\nT g(T x) {\n    return x;\n}\nclass C {\n    void m() { s = "' || q || '"; }\n};\n'""",
    "cs": r"""'using A;\n\nnamespace N {\n    class Inner { }\n}\n[Flags]\npublic class Shop {\n    public Shop(int a) {\n        x = a;\n    }\n    string Say() {\n        return "' || q || '";\n    }\n}\n'""",
    "rb": r"""'def a\nend\n'""",
}
_ENDINGS = "case doc_id % 9 " + " ".join(f"when {i} then '{ending}'" for i, ending in enumerate(_BRACES)) + " end"
_BRACED = "case doc_id % 9 " + " ".join(f"when {i} then {source}" for i, source in enumerate(_BRACES.values())) + " end"


@query(f"""with d as (select *, translate(text, chr(92) || '"`', '') as q from documents), e as (select 'src/' || doc_id || '.' || {_ENDINGS} as path, {_ENDINGS} as ending, replace(replace({_BRACED}, chr(92) || 'n', chr(10)), chr(92) || 't', chr(9)) as source from d),
f as (select path, source, case ending {" ".join(f"when '{e}' then '{lang}'" for e, lang in symbols.ENDINGS.items())} end as lang from e), {symbols.oracle("f")}
select path, item, part, section_header, symbol_type, sha256(text) as digest, length(text)::int as chars from symbols""")
def brace_symbols(spark, sf_dir):
    """Definitions, methods and leftovers of sources in languages with braces."""
    docs = table(spark, sf_dir, "documents").withColumn("q", F.translate("text", '\\"`', ""))
    files = docs.select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit("."), F.expr(_ENDINGS)).alias("path"), F.expr(_BRACED).alias("source"))
    found = symbols.symbols(files.withColumn("lang", symbols.language(F.col("path"))))
    return found.select("path", "item", "part", "section_header", "symbol_type", F.sha2("text", 256).alias("digest"), F.length("text").alias("chars"))


@query()
def split_lines(spark, sf_dir):
    """Tested against a plain version: the splitter is sequential."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(chunking.line_pieces(F.col("text"))).alias("chunk_index", "piece"))


@query("""with recursive o as (select source as grp, doc_id, length(text)::bigint as chars, row_number() over (partition by source order by doc_id) as i from documents),
w as (select grp, doc_id, chars, i, 0::bigint as batch, 1 as rows, chars as total from o where i = 1
union all select o.grp, o.doc_id, o.chars, o.i, case when w.rows >= 30 or w.total >= 48000 then w.batch + 1 else w.batch end, case when w.rows >= 30 or w.total >= 48000 then 1 else w.rows + 1 end, case when w.rows >= 30 or w.total >= 48000 then o.chars else w.total + o.chars end
from w join o on o.grp = w.grp and o.i = w.i + 1) select grp, doc_id, chars, batch from w""")
def embed_batches(spark, sf_dir):
    """The documents of each source in batches for a model."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), "doc_id", "text")
    return chunking.embedding_batches(docs, "grp", "doc_id", "text").withColumnRenamed("n", "chars")


#: What every third note had at its end when the last run parsed it.
_LOST = "chr(10) || 'A sentence that stood in this note when it was parsed by the run before this one.'"


def _sql_chunks(note: str, where: str) -> str:
    """The passages of some documents' notes, as ``chunk_notes`` has them."""
    return registry.ORACLES["chunk_notes"].replace(_NOTE, note).replace(" as t from documents)", f" as t from documents where {where})", 1)


@query(f"""with f as (select source, source || '/' || doc_id || '.md' as path, case when text is null then 'error' when doc_id % 3 = 0 then 'parsed' else 'skipped' end as state from documents),
m as materialized ({_sql_chunks(_NOTE, "doc_id % 3 = 0")}), o as materialized ({_sql_chunks(f"({_NOTE}) || {_LOST}", "doc_id % 3 = 0")}),
c as (select source, count(*) as chunks, count(distinct chunk_id) as stored, sum(length(display_text))::bigint as chars, sum(case when display_text = '' then 0 else greatest(1, floor(len(regexp_extract_all(display_text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) * 1.3::double)::int) end)::bigint as tokens
from m join f on source_path = path group by source), g as (select source, count(*) as gone from o join f on source_path = path where state = 'parsed' and chunk_id not in (select chunk_id from m) group by source)
select source, count(*) as files_scanned, count(*) filter (where state = 'parsed') as files_parsed, count(*) filter (where state = 'skipped') as files_skipped, count(*) filter (where state = 'error') as errors,
coalesce(any_value(chunks), 0) as chunks_produced, coalesce(any_value(chunks), 0) as chunks_embedded, coalesce(any_value(stored), 0) as chunks_stored, coalesce(any_value(chars), 0) as chars, coalesce(any_value(tokens), 0) as tokens, coalesce(any_value(gone), 0) as stale_deleted
from f left join c using (source) left join g using (source) group by source""")
def ingest_summary(spark, sf_dir):
    """The counters of a run over the documents as notes, a third of which have lost a sentence since the last run: what the
    manifest knows is skipped, the others go through the chunker and the model, and their old passages are looked up."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    notes = docs.select("source", "doc_id", path.alias("path"), F.col("doc_id").cast("string").alias("stem"), F.expr(_NOTE).alias("text"))
    before = notes.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.expr(_LOST))).otherwise(F.col("text")))
    states = checkpointed(ingest.classified(notes, before.select("path", F.sha2("text", 256).alias("sha256"))))
    passages = checkpointed(embedding.embedded(chunking.chunk_notes(states.filter("state = 'parsed'")), "embedding_text"))
    stored = chunking.chunk_notes(before.join(states.filter("state = 'parsed'").select("path"), "path", "left_semi"))
    return ingest.counters(states, passages, ingest.outdated(stored, states, passages), "source")


@query("""select doc_id, 32 as dims, list_sum(list_transform(range(32), lambda i: ('0x' || substr(sha256(text), 2 * i + 1, 2))::int))::bigint as total from documents""")
def embed_docs(spark, sf_dir):
    """Documents through the stand-in for an embedding model."""
    found = embedding.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    total = F.aggregate("embedding", F.lit(0).cast("long"), lambda s, x: s + F.round(x * 255).cast("long"))
    return found.select("doc_id", F.size("embedding").alias("dims"), total.alias("total"))


@query("""select doc_id, coalesce(source_name, source) as source_name from (select doc_id, source, case when doc_id % 2 = 0 then 'vault' || doc_id % 3 end as source_name from documents)""")
def source_names(spark, sf_dir):
    """The name a file's source is given, else its repository's."""
    docs = table(spark, sf_dir, "documents").withColumn("source_name", F.expr("case when doc_id % 2 = 0 then 'vault' || doc_id % 3 end"))
    return chunking.named_source(docs, "source").select("doc_id", "source_name")


_NAV = "case doc_id % 4 when 0 then '[[a]]' || chr(10) || chr(10) || '- [[b]]' || chr(10) || substr(text, 1, 60) when 1 then '[[a]]' || chr(10) || '[[b]]' || chr(10) || substr(text, 1, 60) when 2 then ' ' || chr(10) else text end"


@query(f"""with n as (select doc_id, case when doc_id % 9 = 0 then {sql_list(lexicons.NAVIGATION_SECTIONS)}[1] else source end as section, {_NAV} as t from documents),
l as (select *, list_filter(list_transform(string_split(replace(t, chr(13), chr(10)), chr(10)), lambda x: trim(x, {SQL_BLANKS})), lambda x: x <> '') as lines from n)
select doc_id, list_contains({sql_list(lexicons.NAVIGATION_SECTIONS)}, section) or len(lines) = 0 or len(list_filter(lines, lambda x: contains(x, '[[') and contains(x, ']]') and length(x) < 80)) / len(lines) > 0.6 as navigates from l""")
def nav_chunk(spark, sf_dir):
    section = F.when(F.col("doc_id") % 9 == 0, lexicons.NAVIGATION_SECTIONS[0]).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", navigates(section, F.expr(_NAV)).alias("navigates"))


@query(f"""select doc_id, path, regexp_extract(path, '([^/]+)\\.md$', 1) as stem from (select doc_id, case doc_id % 5 when 0 then '.obsidian/' || doc_id || '.md' when 1 then 'a/.trash/x/' || doc_id || '.md' when 2 then 'notes/' || doc_id || '.txt' else source || '/' || doc_id || '.md' end as path from documents)
where path like '%.md' and not list_has_any(string_split(path, '/'), {sql_list(NOTE_DIRS)})""")
def scan_notes(spark, sf_dir):
    """Which paths are notes: what the scan of a folder keeps."""
    path = F.expr("case doc_id % 5 when 0 then '.obsidian/' || doc_id || '.md' when 1 then 'a/.trash/x/' || doc_id || '.md' when 2 then 'notes/' || doc_id || '.txt' else source || '/' || doc_id || '.md' end")
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).filter(F.endswith(F.col("path"), F.lit(".md")) & ~has_part(F.col("path"), NOTE_DIRS))
    return rows.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.md$", 1))
