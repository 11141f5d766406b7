"""Symbols of languages with braces: kinds, names, methods, leftovers, and what hides in strings and comments."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import chunking, symbols

SOURCES = {
    "calc.js": """// { a comment
class Calculator {
    constructor(value) {
        this.value = "}{" + value;
    }

    add(x) { return this.value + x; }
}

async function load(name) {
    const t = `
}}}
`;
    return t;
}
const size = [
    1, 2,
];
export default class Box { }
export { a };
run();
""",
    "types.ts": """interface User {
    name: string;
}
type Id = string
enum Color { Red }
class Service<T> {
    private users: User[] = [];
    add(user: User): void {
        if (user) { push(user); }
    }
}
""",
    "Calc.java": """package a;

import b.C;

@Entity
public class Calc extends Base
        implements D {
    private int value = f(1);

    public Calc(int initial) {
        this.value = initial;
    }

    @Override
    public <T> int add(int x) { return x; }

    abstract int rest();
}
interface Shape { double area(); }
record Pair(int a, int b) { }
""",
    "main.go": """package main

import (
    "fmt"
)

func hello(name string) string {
    return fmt.Sprintf("} %s", name)
}

func (s *Server) Run() error {
    return nil
}

type Server struct {
    Port int
}
""",
    "point.rs": """use std::fmt;

#[derive(Debug)]
pub struct Point {
    x: f64,
}

impl<'a> fmt::Display for Point {
    pub fn distance(&self, other: &'a Point) -> f64 {
        let c = '{';
        0.0
    }
    const ONE: u8 = 1;
}

pub(crate) fn area() -> f64 { 1.0 }
pub trait Shape { fn area(&self) -> f64; }
mod inner { }
""",
    "math.c": """#include <stdio.h>
#define MAX(a, b) \\
    ((a) > (b) ? (a) : (b))

struct pair {
    int a;
};
static int total = 0;
int factorial(int n);
int main(void)
{
    printf("%d }", 5);
    return 0;
}
typedef int number;
""",
    "a.cpp": """namespace deep {
int f() { return 1; }
}
template <typename T>
T id(T x) {
    return x;
}
class Widget : public Base {
    void draw() { }
};
""",
    "Shop.cs": """using System;

[Serializable]
public class Shop {
    public Shop(int a) {
        x = a;
    }
    public string Say() => "}";
}
public struct Coin { }
""",
}
WANT = {
    "calc.js": [("class", "Calculator"), ("method", "Calculator.constructor"), ("method", "Calculator.add"), ("function", "load"), ("variable", "size"), ("export", "Box"), ("export", "export"), ("module", "")],
    "types.ts": [("interface", "User"), ("type", "Id"), ("enum", "Color"), ("class", "Service"), ("method", "Service.add")],
    "Calc.java": [("class", "Calc"), ("constructor", "Calc.Calc"), ("method", "Calc.add"), ("method", "Calc.rest"), ("interface", "Shape"), ("record", "Pair"), ("module", "")],
    "main.go": [("function", "hello"), ("method", "Run"), ("type", "Server"), ("module", "")],
    "point.rs": [("struct", "Point"), ("impl", "Point"), ("function", "Point.distance"), ("function", "area"), ("trait", "Shape"), ("module", "inner"), ("module", "")],
    "math.c": [("struct", "pair"), ("declaration", "static int total = 0;"), ("declaration", "int factorial(int n);"), ("function", "int main(void)"), ("module", "")],
    "a.cpp": [("namespace", "deep"), ("template", "template <typename T>"), ("class", "Widget")],
    "Shop.cs": [("class", "Shop"), ("constructor", "Shop.Shop"), ("method", "Shop.Say"), ("struct", "Coin"), ("module", "")],
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame(list(SOURCES.items()), "path string, source string").withColumn("lang", symbols.language(F.col("path")))
    return symbols.symbols(files).orderBy("path", "item", "part").collect()


@pytest.mark.parametrize("path", list(SOURCES))
def test_kinds_and_names(found, path):
    assert [(r["symbol_type"], r["section_header"]) for r in found if r["path"] == path] == WANT[path]


def test_texts_are_whole(found):
    text = {(r["path"], r["section_header"]): r["text"] for r in found}
    assert text["calc.js", "load"].endswith("return t;\n}") and text["calc.js", ""] == "run();"
    assert text["calc.js", "Calculator.add"] == "add(x) { return this.value + x; }"
    assert text["Calc.java", "Calc"].startswith("@Entity") and text["Calc.java", "Calc.add"].startswith("@Override")
    assert text["main.go", ""] == 'package main\nimport (\n    "fmt"\n)' and text["math.c", "int main(void)"].endswith("return 0;\n}")
    assert "derive" in text["point.rs", ""] and text["math.c", ""].count("\n") == 3


def test_masks_keep_lines_and_lengths(spark):
    rows = spark.createDataFrame([("a \"x\\\"{\" /* {\n{ */ b 'c' // }\n`{\n`",), ("",), ("'open { and \"",), ("x" * 200_000 + '"' + "{" * 200_000 + '"',)], "t string")
    got = rows.select("t", symbols.masked(F.col("t"), F.lit("js")).alias("m")).collect()
    assert all(len(r["t"]) == len(r["m"]) and [i for i, c in enumerate(r["t"]) if c == "\n"] == [i for i, c in enumerate(r["m"]) if c == "\n"] for r in got)
    assert "{" not in got[0]["m"] and "{" in got[2]["m"] and "{" not in got[3]["m"]


def test_long_symbols_are_cut_in_parts(spark):
    body = "".join(f"    call{i}(value, other, {i});\n" for i in range(150))
    files = [("a.js", "r", f"function big() {{\n{body}}}\nfunction small() {{\n{body[:300]}\n}}\n"), ("none.js", "r", "// nothing\n"), ("tiny.js", "r", "f();")]
    rows = sorted(chunking.chunk_code(spark.createDataFrame(files, "path string, repo_name string, source string")).collect(), key=lambda r: r["chunk_index"])
    assert [r["section_header"] for r in rows] == ["big (part 1)", "big (part 2)", "big (part 3)", "small"] and [r["chunk_index"] for r in rows] == [0, 1, 2, 3]
    assert all(len(r["display_text"]) <= 2300 and r["embedding_text"].startswith("Repo: r | Ficheiro: a.js | Function: ") for r in rows)


def test_files_are_dealt_out_and_masked_once(spark):
    files = spark.createDataFrame(list(SOURCES.items()), "path string, source string").withColumn("lang", symbols.language(F.col("path")))
    plan = symbols.symbols(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("Exchange ") == 1 and "Join" not in plan


def test_parts_of_many_items_stay_in_their_order(spark):
    """Definitions between leftovers, and more items in a file than an aggregate keeps without a sort."""
    text = "".join(f"class C{i} {{\n    m{i}(a) {{ return '{{'; }}\n\n    n(b) {{ }}\n}}\ncall({i});\n" for i in range(300))
    files = spark.createDataFrame([("a.js", text, "js"), ("b.js", "/* nothing */\n", "js"), ("c.js", "f();", "js")], "path string, source string, lang string")
    rows = symbols.symbols(files).orderBy("path", "item", "part").collect()
    want = [h for i in range(300) for h in (f"C{i}", f"C{i}.m{i}", f"C{i}.n")]
    assert [r["section_header"] for r in rows] == [*want, "", ""] and rows[-2]["text"] == "\n".join(f"call({i});" for i in range(300))
    assert rows[1]["text"] == "m0(a) { return '{'; }" and {r["path"] for r in rows} == {"a.js", "c.js"}
