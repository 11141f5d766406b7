"""Symbols of languages with braces: top-level definitions, methods of classes and what is left, by nesting depth.

Comments and strings are blanked out, and running sums of what opens and closes over a file's lines give the depth at
which each line begins. Lines at depth 0 where nothing goes on from the line before begin items; the lines inside an item
belong to it. Kinds and names come from the items' heads. All of it is column expressions and one window over a file;
files are dealt out once, as sources, and what follows is done where a file lies.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Languages by the ending of a file's name.
ENDINGS = {
    "js": "js", "jsx": "js", "mjs": "js", "ts": "ts", "tsx": "ts", "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp",
}
#: Comments, strings and what lies between them, as whole pieces that cover a text.
PIECES = r"""(?s)//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`[^`]*`|[^/"'`]++|."""
RUST_PIECES = PIECES.replace(r"'(?:[^'\\\n]++|\\.)*+'", r"'(?:[^'\\\n]|\\[^\n']{1,9})'")
#: In C a directive is a piece, with the lines that a backslash adds to it.
C_PIECES = PIECES.replace("(?s)", r"(?sm)^[ \t]*#(?:[^\n\\]++|\\.)*+|").replace(r"""[^/"'`]++""", r"""[^/"'`\n]++""")
DIRECTIVE = r"^[ \t]*#."
HIDDEN = r"""^(?://|/\*|["'`])."""
#: A line that begins so goes on with the one before; as does one after a line that ends or begins so.
GOES_ON = r"^[{})\];]"
#: In languages with terminators all but these ends lead on; in the others only these do.
STRICT, ENDED = ("java", "c", "cpp", "csharp", "rust"), r"[;{}]$|^#"
OPEN_END = r"(?:[,=(\[+*/|&?:.<-]|=>)$|^@[^{};]*$"
_MODS = r"(?:(?:@[\w.]+(?:\([^)]*\))?|\[[^\]]*\]|public|private|protected|internal|static|final|abstract|sealed|partial|strictfp|unsafe|readonly|ref|new|non-sealed)\s*)*"
_PUB = r"(?:pub(?:\([^)]*\))?\s+)?"
#: What an item is, by its head: language, kind, pattern (its first group is the name; without one the first line is).
KINDS = [
    *((lang, "export", p) for lang in ("js", "ts") for p in (r"^export\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)", r"^export\s+(?:default\s+)?class\s+([\w$]+)", r"^export\s+(?:const|let|var)\s+([\w$]+)", r"^(export)\b")),
    *((lang, kind, p) for lang in ("js", "ts") for kind, p in (("function", r"^(?:async\s+)?function\s+([\w$]+)"), ("class", r"^class\s+([\w$]+)"), ("variable", r"^(?:const|let|var)\s+([\w$]+)"))),
    ("ts", "interface", r"^interface\s+([\w$]+)"), ("ts", "type", r"^type\s+([\w$]+)"), ("ts", "enum", r"^enum\s+([\w$]+)"),
    *(("java", kind, rf"^{_MODS}{kind}\s+(\w+)") for kind in ("class", "interface", "enum", "record")),
    ("go", "method", r"^func\s+\([^)]*\)\s*(\w+)"), ("go", "function", r"^func\s+(\w+)"), ("go", "type", r"^type\s+(\w+)"),
    ("rust", "function", rf"^{_PUB}(?:(?:const|async|unsafe)\s+|extern\s+)*fn\s+(\w+)"), ("rust", "impl", r"^(?:unsafe\s+)?impl\b(?:<[^{]*?>)?\s+(?:[^{]*\sfor\s+)?([^{]+?)\s*(?:\swhere\b[^{]*)?\{"),
    *(("rust", kind, rf"^{_PUB}{word}\s+(\w+)") for kind, word in (("struct", "struct"), ("enum", "enum"), ("trait", "(?:unsafe\\s+)?trait"), ("module", "mod"), ("type", "type"))),
    *((lang, kind, rf"^{kind}\s+(\w+)[^;(={{]*\{{") for lang in ("c", "cpp") for kind in ("struct", "enum")),
    ("cpp", "class", r"^class\s+(\w+)[^;(={]*\{"), ("cpp", "namespace", r"^(?:inline\s+)?namespace\s+([\w:]+)[^;={]*\{"), ("cpp", "template", r"^template\b()"),
    *((lang, "function", r"^[\w:*&<>,~\s]+\([^;={]*\)[^;={]*\{()") for lang in ("c", "cpp")),
    *((lang, "declaration", r"^(?:extern|static|const|unsigned|signed|struct|enum|[A-Za-z_])[\w:*&<>,\s]*[\s*&][A-Za-z_]\w*\s*(?:[;=\[,(])()") for lang in ("c", "cpp")),
    *(("csharp", kind, rf"^{_MODS}{kind}\s+(\w+)") for kind in ("class", "struct", "interface", "enum")), ("csharp", "namespace", r"^namespace\s+([\w.]+)[^;{]*\{"),
]
NOT_DECLARED = r"^(?:typedef|using|return|#)"
#: Kinds whose bodies have methods, by language, and what a method's head is.
METHODS = {
    "js": (("class",), r"^(?:(?:static|async|get|set)\s+)*\*?\s*([#A-Za-z_$][\w$]*)\s*\([^{]*\{"),
    "ts": (("class",), r"^(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?\s*([#A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\([^{]*\{"),
    "java": (("class",), r"^(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:[\w<>\[\],.?]+\s+)*([A-Za-z_]\w*)\s*\([^=]*[;{]"),
    "csharp": (("class",), r"^(?:\[[^\]]*\]\s*)*(?:[\w<>\[\],.?]+\s+)*([A-Za-z_]\w*)\s*\([^=]*(?:[;{]|=>)"),
    "rust": (("impl",), rf"^{_PUB}(?:(?:const|async|unsafe)\s+|extern\s+)*fn\s+(\w+)[^;]*\{{"),
}
NAME_CHARS, HEAD_CHARS = 60, 80
_ROW = "struct<item: bigint, part: bigint, section_header: string, symbol_type: string, text: string>"


def language(path: Column) -> Column:
    """The language of a file by its ending; null for the others."""
    ending = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(F.contains(path, F.lit(".")), F.element_at(F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair)), ending))


def masked(text: Column, lang: Column) -> Column:
    """The text with blanks for all characters of comments and strings but line ends; each line of a C directive is a sign."""
    cut = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    in_c = lang.isin("c", "cpp")
    pieces = F.when(lang == "rust", cut(RUST_PIECES)).when(in_c, cut(C_PIECES)).otherwise(cut(PIECES))
    blank = lambda p: F.array_join(F.transform(F.split(p, "\n"), lambda line: F.repeat(F.lit(" "), F.length(line))), "\n")
    return F.array_join(F.transform(pieces, lambda p: F.when(in_c & p.rlike(DIRECTIVE), F.regexp_replace(p, r"[^\n]+", "#")).when(p.rlike(f"(?s){HIDDEN}"), blank(p)).otherwise(p)), "")


def _count(line: Column, signs: str) -> Column:
    """How many of these signs, of one byte each, a line has."""
    return F.octet_length(line) - F.octet_length(functools.reduce(lambda rest, sign: F.replace(rest, F.lit(sign), F.lit("")), signs, line))


def _begins(depth: int) -> Column:
    """Whether a line begins an item at this depth."""
    strict = F.col("lang").isin(*STRICT)
    leads_on = F.when(strict, ~F.col("last").rlike(ENDED)).otherwise(F.col("last").rlike(OPEN_END))
    return (F.col("depth") == depth) & (F.col("bare") != "") & ~F.col("bare").rlike(GOES_ON) & ~F.coalesce(leads_on, F.lit(False))


def code_lines(files: DataFrame) -> DataFrame:
    """``path, lang, no, line, bare, depth, item, part``: the lines of files (``path, lang, source``) that belong to items.

    ``item`` counts the items of a file and ``part`` what begins inside at depth 1; blank lines and comments between
    items are left out.
    """
    text = F.replace("source", F.lit("\r\n"), F.lit("\n"))
    rows = files.select("path", "lang", text.alias("source")).repartition("path").withColumn("mask", masked(F.col("source"), F.col("lang")))
    both = F.arrays_zip(F.split("source", "\n").alias("line"), F.split("mask", "\n").alias("mask"))
    lines = rows.select("path", "lang", F.posexplode(both).alias("no", "l")).select("path", "lang", "no", "l.line", F.btrim(F.col("l.mask"), F.lit(" \t\r\f")).alias("bare"))
    by = Window.partitionBy("path").orderBy("no")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    grown = _count(F.col("bare"), "{([") - _count(F.col("bare"), "})]")
    lines = lines.withColumns({"depth": F.coalesce(F.sum(grown).over(before), F.lit(0)), "last": F.last(F.when(F.col("bare") != "", F.col("bare")), ignorenulls=True).over(before)})
    lines = lines.withColumns({"item": F.sum(_begins(0).cast("int")).over(by), "part": F.sum(_begins(1).cast("int")).over(by)})
    return lines.filter((F.col("item") > 0) & ~((F.col("depth") <= 0) & (F.col("bare") == ""))).drop("last")


def _text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["line"]), "\n")


def _masked_line(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["bare"]), " ")


def _head(masked_line: Column) -> Column:
    """A masked text in one line, up to the first brace."""
    cut = F.when(F.contains(masked_line, F.lit("{")), F.concat(F.substring_index(masked_line, "{", 1), F.lit("{"))).otherwise(masked_line)
    return F.btrim(F.regexp_replace(cut, r"\s+", " "))


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x["text"]), "\n")


def _first_line(text: Column) -> Column:
    return F.substring(F.btrim(F.substring_index(F.substring(F.ltrim(text), 1, HEAD_CHARS), "\n", 1)), 1, NAME_CHARS)


def symbols(files: DataFrame) -> DataFrame:
    """``path, item, part, section_header, symbol_type, text``: the symbols of files (``path, lang, source``).

    ``item`` is the place of a definition in its file, ``part`` that of a method in its class and 0 for the definition
    itself. What is no definition is joined to one row of the kind module at the end, its header left empty. Files of
    blanks and comments have none; a file is read in one task, whole.
    """
    lines = code_lines(files.filter("lang is not null and source is not null"))
    # A part's number only grows along a file, so an item's parts in order are its lines in order.
    parts = lines.groupBy("path", "lang", "item", "part").agg(F.array_sort(F.collect_list(F.struct("no", "line", "bare", "depth"))).alias("l"))
    items = parts.groupBy("path", "lang", "item").agg(F.array_sort(F.collect_list(F.struct("part", "l"))).alias("parts"))
    whole = F.flatten(F.transform("parts", lambda p: p["l"]))
    items = items.withColumns({"text": _text(whole), "bare": _masked_line(whole)}).withColumn("head", _head(F.col("bare"))).drop("bare")
    told = F.lit(None).cast("struct<kind: string, name: string>")
    for lang, kind, pattern in reversed(KINDS):
        fits = (F.col("lang") == lang) & F.col("head").rlike(pattern)
        fits = fits & ~F.col("head").rlike(NOT_DECLARED) if kind in ("declaration", "function") and lang in ("c", "cpp") else fits
        told = F.when(fits, F.struct(F.lit(kind).alias("kind"), F.regexp_extract("head", pattern, 1).alias("name"))).otherwise(told)
    items = items.withColumn("told", told).withColumn("name", F.when(F.col("told.name") == "", _first_line(F.col("text"))).otherwise(F.col("told.name")))
    owns = F.expr(" or ".join(f"lang = '{lang}' and told.kind in ({', '.join(repr(k) for k in kinds)})" for lang, (kinds, _) in METHODS.items()))
    bodies = F.transform("parts", lambda p: F.struct(p["part"].alias("part"), F.filter(p["l"], lambda x: (x["depth"] >= 1) & ~((x["depth"] == 1) & ((x["bare"] == "") | F.startswith(x["bare"], F.lit("}"))))).alias("l")))
    bodies = F.transform(F.filter(bodies, lambda b: F.size(b["l"]) > 0), lambda b: F.struct(b["part"].alias("part"), F.btrim(_text(b["l"])).alias("text"), _masked_line(b["l"]).alias("bare")))
    heads = F.transform(bodies, lambda b: F.struct(b["part"].alias("part"), b["text"].alias("text"), _head(b["bare"]).alias("head")))

    def method(b: Column) -> Column:
        found = F.lit(None).cast("string")
        for lang, (_, pattern) in METHODS.items():
            found = F.when((F.col("lang") == lang) & b["head"].rlike(pattern), F.regexp_extract(b["head"], pattern, 1)).otherwise(found)
        return F.struct(b["part"].alias("part"), b["text"].alias("text"), found.alias("name"))

    methods = F.filter(F.transform(heads, method), lambda m: m["name"].isNotNull())
    kind = lambda m: F.when(F.col("lang") == "rust", "function").when(F.col("lang").isin("java", "csharp") & (m["name"] == F.col("name")), "constructor").otherwise("method")
    row = lambda item, part, header, kind, text: F.struct(item.alias("item"), part.cast("long").alias("part"), header.alias("section_header"), kind.alias("symbol_type"), text.alias("text"))
    own = F.array(row(F.col("item"), F.lit(0), F.col("name"), F.col("told.kind"), F.col("text")))
    inside = F.when(owns, F.transform(methods, lambda m: row(F.col("item"), m["part"], F.concat_ws(".", F.col("name"), m["name"]), kind(m), m["text"])))
    found = F.when(F.col("told").isNotNull(), F.concat(own, F.coalesce(inside, F.array().cast(f"array<{_ROW}>"))))
    left = F.when(F.col("told").isNull(), F.struct("item", F.btrim("text").alias("text")))
    by_file = items.select("path", "item", found.alias("found"), left.alias("left")).groupBy("path").agg(F.flatten(F.collect_list("found")).alias("found"), F.array_sort(F.collect_list("left")).alias("left"))
    rest = row(F.lit(1 << 40) + F.element_at("left", -1)["item"], F.lit(0), F.lit(""), F.lit("module"), _joined(F.col("left")))
    every = F.concat("found", F.when(F.size("left") > 0, F.array(rest)).otherwise(F.array().cast(f"array<{_ROW}>")))
    return by_file.select("path", F.explode(every).alias("s")).select("path", "s.*")


def oracle(files: str) -> str:
    """``symbols`` of a DuckDB relation (``path, lang, source``) as common table expressions that end in ``symbols``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    plain = lambda s: s.replace("++", "+").replace("*+", "*")
    blanks = "' ' || chr(9) || chr(13) || chr(12)"
    begins = lambda d: f"(case when depth = {d} and bare <> '' and not regexp_matches(bare, {q(GOES_ON)}) and not coalesce(case when lang in {STRICT} then not regexp_matches(last, {q(ENDED)}) else regexp_matches(last, {q(OPEN_END)}) end, false) then 1 else 0 end)"
    joined = lambda by: f"""path, lang, {by}, string_agg(line, chr(10) order by no) as text, trim(regexp_replace(string_agg(bare, ' ' order by no), '\\s+', ' ', 'g')) as one"""
    head = "case when contains(one, '{') then split_part(one, '{', 1) || '{' else one end as head"
    fits = [(f"lang = {q(lang)} and regexp_matches(head, {q(p)})" + (f" and not regexp_matches(head, {q(NOT_DECLARED)})" if kind in ("declaration", "function") and lang in ("c", "cpp") else ""), kind, p) for lang, kind, p in KINDS]
    first_line = f"substring(trim(split_part(substring(ltrim(text), 1, {HEAD_CHARS}), chr(10), 1)), 1, {NAME_CHARS})"
    return f"""f0 as (select path, lang, replace(source, chr(13) || chr(10), chr(10)) as source from {files} where lang is not null and source is not null),
f1 as (select *, array_to_string(list_transform(regexp_extract_all(source, case when lang = 'rust' then {q(plain(RUST_PIECES))} when lang in ('c', 'cpp') then {q(plain(C_PIECES))} else {q(plain(PIECES))} end), lambda p: case when lang in ('c', 'cpp') and regexp_matches(p, {q(DIRECTIVE)}) then regexp_replace(p, '[^\\n]+', '#', 'g') when regexp_matches(p, {q("(?s)" + HIDDEN)}) then regexp_replace(p, '[^\\n]', ' ', 'g') else p end), '') as mask from f0),
f2 as (select path, lang, unnest(string_split(source, chr(10))) as line, trim(unnest(string_split(mask, chr(10))), {blanks}) as bare, generate_subscripts(string_split(source, chr(10)), 1) as no from f1),
f3 as (select *, coalesce(sum(length(regexp_replace(bare, '[^{{(\\[]', '', 'g')) - length(regexp_replace(bare, '[^}})\\]]', '', 'g'))) over w, 0) as depth, last_value(nullif(bare, '') ignore nulls) over w as last from f2 window w as (partition by path order by no rows between unbounded preceding and 1 preceding)),
f4 as materialized (select *, sum({begins(0)}) over w as item, sum({begins(1)}) over w as part from f3 window w as (partition by path order by no rows unbounded preceding)),
f5 as materialized (select * from f4 where item > 0 and not (depth <= 0 and bare = '')),
i1 as (select *, {head} from (select {joined("item")} from f5 group by path, lang, item)),
i2 as (select *, case {" ".join(f"when {w} then {q(kind)}" for w, kind, _ in fits)} end as symbol_type, case {" ".join(f"when {w} then regexp_extract(head, {q(p)}, 1)" for w, _, p in fits)} end as n from i1),
i3 as materialized (select *, case when n = '' then {first_line} else n end as name from i2),
o as (select path, item, name as owner from i3 where {" or ".join(f"lang = {q(lang)} and symbol_type in ({', '.join(q(k) for k in kinds)})" for lang, (kinds, _) in METHODS.items())}),
p1 as (select *, {head} from (select {joined("item, part, owner")} from f5 join o using (path, item) where depth >= 1 and not (depth = 1 and (bare = '' or starts_with(bare, '}}'))) group by path, lang, item, part, owner)),
p2 as (select *, case {" ".join(f"when lang = {q(lang)} and regexp_matches(head, {q(p)}) then regexp_extract(head, {q(p)}, 1)" for lang, (_, p) in METHODS.items())} end as name from p1),
symbols as (select path, item::bigint as item, 0::bigint as part, name as section_header, symbol_type, text from i3 where symbol_type is not null
union all select path, {1 << 40} + max(item)::bigint, 0, '', 'module', string_agg(trim(text), chr(10) order by item) from i3 where symbol_type is null group by path
union all select path, item::bigint, part::bigint, owner || '.' || name, case when lang = 'rust' then 'function' when lang in ('java', 'csharp') and name = owner then 'constructor' else 'method' end, trim(text) from p2 where name is not null)"""
