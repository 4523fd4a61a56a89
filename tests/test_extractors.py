import random
import re
import time

import pytest
from pyspark.sql import functions as F

from codescope.functions import javascript_source as js
from codescope.functions import python_source as py
from codescope.functions import text


def one(spark, content, column):
    return spark.createDataFrame([(content,)], "content string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "content, n", [("", 0), ("a", 1), ("a\n", 1), ("a\n\n", 2), ("\n", 1), ("a\r\nb", 2)]
)
def test_line_count(spark, content, n):
    assert one(spark, content, text.line_count(F.col("content"))) == n
    assert len(one(spark, content, text.lines_of(F.col("content")))) == n


def test_prefix_sum(spark):
    rng = random.Random(1)
    rows = [([rng.randint(-3, 3) for _ in range(n)],) for n in [0, 1, 2, 3, 4, 5, 8, 9, 31, 33, 1000]]
    df = spark.createDataFrame(rows, "v array<int>").select("v", text.prefix_sum(F.col("v")).alias("s"))
    for r in df.collect():
        total, want = 0, []
        for x in r["v"]:
            total += x
            want.append(total)
        assert r["s"] == want


@pytest.mark.parametrize(
    "content, bodies",
    [
        ("x = 1\n\ndef f():\n    return 1\n", [""]),
        ("def a():\n  pass\ndef b():\n\n\n  q\n  r", ["  pass\ndef b():", "  q\n  r"]),
        ("class A:\n    def h(self): return 3\n", [""]),
        ("def f(): return 1\nx\n", [" return 1\nx"]),
        ("def f():\r\n  a\r\n  b\r\n", ["  a\n  b"]),
    ],
)
def test_python_bodies(spark, content, bodies):
    got = one(spark, content, py.functions(F.col("content")))
    assert [f["body"] for f in got] == bodies


def test_python_block_mode(spark):
    content = "x = 1\n\ndef f(a,\n)...\n\ndef g(a):\n    if a:\n\n        return 1\n\n    def k(): return 2\n\n\ny = 1\n"
    got = one(spark, content, py.functions(F.col("content"), "block"))
    assert [(f["name"], f["body"], f["cyclomatic_complexity"]) for f in got] == [
        ("g", "    if a:\n\n        return 1\n\n    def k(): return 2", 2),
        ("k", " return 2", 1),
    ]


@pytest.mark.parametrize(
    "content, bodies",
    [
        ("function f(a) {\n  return a\n}\n", ["\n"]),
        ("function f(a) { return a }\ng(() => {\n", [" return a }\ng(() => {\n"]),
        ("const h = (a) => {\n  if (a) {\n    b\n  }\n}\nx\n", [" {\n  if (a) {\n    b\n  }\n}\n"]),
        ("const h = (a) => a;", [" a;\n"]),
        ("const h = (a) =>", [""]),
    ],
)
def test_js_bodies(spark, content, bodies):
    got = one(spark, content, js.functions(F.col("content")))
    assert [f["body"] for f in got] == bodies


def test_js_block_mode(spark):
    content = "export async function p(a, b): T {\n  if (a) {\n    b\n  }\n}\nconst z = () => 1\n"
    got = one(spark, content, js.functions(F.col("content"), "block"))
    assert [(f["name"], f["body"], f["cyclomatic_complexity"], f["returns"]) for f in got] == [
        ("p", "\n  if (a) {\n    b\n  }\n}\n", 2, True),
        ("z", " 1\n", 1, False),
    ]
    assert got[0]["signature"] == "const p = (a, b): T => "


def test_imports_types_exports(spark):
    p = "import os\r\nfrom a.b import c, d as e  # x\n  import no\nfrom q import (\n y)\nclass A:\n  class B(A): pass\n"
    assert one(spark, p, py.imports(F.col("content"))) == ["os\r", "c, d as e  # x from a.b", "( from q"]
    assert one(spark, p, py.types(F.col("content"))) == ["A", "B"]
    assert one(spark, p, py.exports(F.col("content"))) == []
    j = (
        'import a from "m1"\nimport {b,\n c} from \'m2\';\nimport * as d, {e} from "m3";\nimport "m4";\n'
        'import type {t} from "no";\nconst {f} = require("m5")\n  const g = require("no");\nlet h = require(\'m6\').x;\n'
        "export type T = 1\n  interface U {}\nexport class K {}\nexport default function q() {}\n"
    )
    assert one(spark, j, js.imports(F.col("content"))) == ["m1", "m2", "m3", "m4", "m5"]
    assert one(spark, j, js.types(F.col("content"))) == ["T", "U"]
    assert one(spark, j, js.exports(F.col("content"))) == ["T", "K"]


def test_cyclomatic_js_operators(spark):
    assert one(spark, "return a&&b || a && b else if", js.cyclomatic(F.col("content"))) == 4


PY_PARTS = [
    "def f(a, b):", "def g():", "    def h(self, x: int) -> int :", "  return 1", "    if x and y:", "", "   ", "\t",
    "x = 1", "class A:", "def bad(", "    y = é", "def k(a) ->", " T:", "def o(): return 1", "\r",
]
JS_PARTS = [
    "function f(a) {", "  return 1", "}", "const g = (x) => {", "const h = (a, b): T => a", "function o(a: s): s;",
    "", "  ", "export async function p() {", "{", "} }", "let q = async (n) => x", "  if (a&&b) { c }", "\r",
    "function w() { return 1 }",
]


@pytest.mark.parametrize("module, parts", [(py, PY_PARTS), (js, JS_PARTS)])
def test_functions_of_random_files_hold_together(spark, module, parts):
    """What SURVEY says of any file: bodies are stretches of it, in order, and counts follow from them."""
    rng = random.Random(7)
    texts = [
        "\n".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) + rng.choice(["", "\n"]) for _ in range(600)
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    n = 0
    for r in df.select("i", module.functions(F.col("content")).alias("f")).collect():
        text = texts[r["i"]].replace("\r\n", "\n")
        for f in r["f"]:
            body = f["body"]
            assert body.rstrip("\n") in text
            assert f["lines_of_code"] == len(body.splitlines() if module is js else body.split("\n") if body else [])
            params = re.search(r"\((.*?)\)", f["signature"])[1]
            assert f["parameters"] == sum(1 for p in params.split(",") if p.strip())
            assert f["name"] in text and f["name"] in f["signature"]
            if module is py:
                assert all(line.strip() for line in body.split("\n")) or not body
            else:  # the braces of all lines but the last never balance before it
                depth, lines = 0, body.split("\n")[:-1]
                for k, line in enumerate(lines):
                    depth += line.count("{") - line.count("}")
                    assert depth != 0 or k == len(lines) - 1
            n += 1
    assert n > 500


def test_large_and_hostile_files(spark):
    blank = "\n" * 200_000 + "x = 1\n"
    long_py = "def f():\n" + "    y = 1\n" * 200_000
    assert one(spark, blank, py.functions(F.col("content"))) == []
    assert one(spark, long_py, py.functions(F.col("content")))[0]["lines_of_code"] == 200_000
    long_js = "const f = () => {\n" + "  a();\n" * 100_000 + "}\nb\n"
    assert one(spark, long_js, js.functions(F.col("content")))[0]["lines_of_code"] == 100_002
    assert one(spark, blank, js.imports(F.col("content"))) == []
    names = "import a" + ", a" * 50_000 + " from 'm'\n"
    assert one(spark, names, js.imports(F.col("content"))) == ["m"]
    gaps = "def f():\n    x\n" + "\n" * 100_000 + "    y\n"
    assert one(spark, gaps, py.functions(F.col("content"), "block"))[0]["lines_of_code"] == 100_002


@pytest.mark.parametrize(
    "line",
    [
        "export function f(a: string): void;\n",
        "const f = (a) => a + 1;\n",
        "const f = (a) => {\n  return a;\n}\n",
        "function f(a) {\n  return a;\n}\n",
        "function f(a)\n",
        "const f = (a): T\n",
    ],
)
def test_javascript_time_grows_with_the_file(spark, line):
    """Eight times the lines take less than 24 times the time: pairs of functions are never looked at."""

    def seconds(n):
        df = spark.createDataFrame([(line * n,)], "content string")
        start = time.perf_counter()
        df.select(F.size(js.functions(F.col("content")))).collect()
        return time.perf_counter() - start

    seconds(10)
    base = seconds(10)  # planning, whatever the file
    small, large = seconds(4000) - base, seconds(32000) - base
    assert large < 24 * max(small, 0.25)


def test_javascript_bodies_end_at_the_first_line_of_equal_depth(spark):
    source = "\n".join(
        ["function a() {", "  if (x) {", "  }", "}", "const b = () => {", "  const c = () => {", "  }", "}", "function open() {", "  {", "const last = (x) => { {", "}", "tail"]
    )
    got = one(spark, source, js.functions(F.col("content"), "block"))
    assert [(f["name"], f["body"]) for f in got] == [
        ("a", "\n  if (x) {\n  }\n}\n"),
        ("open", "\n  {\nconst last = (x) => { {\n}\ntail\n"),
        ("b", " {\n  const c = () => {\n  }\n}\n"),
        ("c", " {\n  }\n"),
        ("last", " { {\n}\ntail\n"),
    ]
