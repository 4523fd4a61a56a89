import random

import pytest
from pyspark.sql import functions as F

from codescope.functions import rust_source as rs

SOURCE = r'''//! crate docs
#![allow(dead_code, unused(x))]
use std::io;
use crate::a::{b, c as d}; // trailing { brace
pub use self::x::*;

/* block { /* nested } */ comment */
/// Says "hi" \ there
#[derive(Debug, Clone)]
pub struct S<'a> { a: &'a str, b: Vec<Vec<u8>>, }

struct T(u8, String);
pub(crate) enum E { A, B(u8) }
pub type R<T> = Result<T, E>;
const X: S = S { a: "}", b: vec![] };
static Y: [u8; 3] = [1, 2, 3];
trait Q { fn inner(&self); }

impl<'a> S<'a> {
    fn method(&self) -> u8 { if true { 1 } else { 2 } }
}

mod tests { fn hidden() {} }

macro_rules! m { ($x:expr) => { if $x {} } }

// not part of the item {
/// doc line
#[inline]
pub async fn run<F: Fn(u8, u8) -> u8>(f: F, mut b: HashMap<String, Vec<u8>>, (x, y): (u8, u8),) -> Result<u8, E>
where
    F: Send,
{
    let s = r#"quote " { if "#;
    let c = '{';
    let t = '\'';
    if s.len() > 1 && c == 'a' { return Ok(1); } else if x { loop { break; } }
    println!("{}", if x { 1 } else { 2 });
    while let Some(z) = b.get("k") { f(1, 2); }
    match x { 0 => 1, n if n > 3 => { if y { 2 } else { 3 } } _ => match y { _ => 4 } };
    if !(x) { }
    let v = (0..3).map(|q| q + 1);
    Ok(0)
}

fn quiet() {}
extern "C" fn ext(a: u8) {}
pub unsafe fn danger(self_: &mut u8) -> ! { loop {} }
'''


@pytest.fixture(scope="module")
def row(spark):
    c = F.col("content")
    return (
        spark.createDataFrame([(SOURCE,)], "content string")
        .select(
            rs.imports(c).alias("imports"),
            rs.types(c).alias("types"),
            rs.exports(c).alias("exports"),
            rs.functions(c).alias("functions"),
            rs.functions(c, "block").alias("block_functions"),
            rs.is_balanced(c).alias("balanced"),
        )
        .first()
    )


def test_imports(row):
    assert row["imports"] == [
        "use std :: io ;", "use crate :: a :: { b , c as d } ;", "pub use self :: x :: * ;"
    ]


def test_types(row):
    assert row["types"] == [
        '# [doc = " Says \\"hi\\" \\\\ there"] # [derive (Debug , Clone)] '
        "pub struct S < 'a > { a : & 'a str , b : Vec < Vec < u8 > > , }",
        "struct T (u8 , String) ;",
        "pub (crate) enum E { A , B (u8) }",
        "pub type R < T > = Result < T , E > ;",
        "impl < 'a > S < 'a > { fn method (& self) -> u8 { if true { 1 } else { 2 } } }",
    ]


def test_exports(row):
    assert row["exports"] == ["struct S", "type R", "fn run", "fn danger"]


def test_functions(row):
    run, quiet, ext, danger = row["functions"]
    assert run["name"] == "run"
    assert run["signature"] == (
        "async fn run < F : Fn (u8 , u8) -> u8 > (f : F , mut b : HashMap < String , Vec < u8 > > , "
        "(x , y) : (u8 , u8) ,) -> Result < u8 , E > where F : Send ,"
    )
    assert run["types"] == "Fn (u8, F, HashMap < String, (u8, Send"
    assert run["parameters"] == 3
    assert run["returns"] is True
    assert run["lines_of_code"] == 17
    # if, else if, loop, while, 3 arms, if, 1 arm, if !(x)
    assert run["cyclomatic_complexity"] == 1 + 10
    assert (quiet["signature"], quiet["body"], quiet["parameters"], quiet["returns"]) == ("fn quiet ()", "{ }", 0, False)
    assert (ext["signature"], ext["parameters"]) == ('extern "C" fn ext (a : u8)', 1)
    assert (danger["signature"], danger["body"]) == ("unsafe fn danger (self_ : & mut u8) -> !", "{ loop { } }")


def test_block_mode_keeps_source(row):
    assert row["block_functions"][0]["body"].startswith("{\n    let s = r#")
    assert row["block_functions"][1]["body"] == "{}"


def test_balance(spark, row):
    assert row["balanced"] is True
    df = spark.createDataFrame([("fn f() {",), ("}",), ("",), ("// {",)], "content string")
    assert [r[0] for r in df.select(rs.is_balanced(F.col("content"))).collect()] == [False, False, True, True]


def test_large_file(spark):
    big = "fn f() {\n" + "    let a = g(1, [2], \"}\"); // {\n" * 50_000 + "}\n" + "/* x */ fn q() {}\n" * 2000
    df = spark.createDataFrame([(big,)], "content string")
    r = df.select(rs.functions(F.col("content")).alias("f")).first()["f"]
    assert (r[0]["lines_of_code"], r[0]["body"], len(r)) == (50_002, None, 2001)


@pytest.mark.parametrize("depth", [1, 4, 15, 17, 1000])
def test_deep_comments_and_attributes(spark, depth):
    text = "/*" * depth + " { " + "*/" * depth + " #![doc = \"a]b\"]\n#[a(" + "[" * depth + "1" + "]" * depth + ")]\nfn shown() {}\n"
    row = spark.createDataFrame([(text,)], "content string").select(rs.functions(F.col("content")).alias("f")).head()
    assert [f["name"] for f in row["f"]] == ["shown"]


def test_deep_comments_hide_what_they_hold(spark):
    """Random texts: a comment of any depth counts as one without nesting, wherever it stands."""
    rng = random.Random(4)
    around = ["fn a%d() { b(); }", "pub struct S%d { a: u8 }", 'const X%d: &str = "/* \\" // */";', "use m%d::x;", "fn c%d() { let q = '\"'; let s = r#\"\" /*\"#; }", "// line /* %d\n", "fn l%d<'a>(x: &'a str) { let c = '\\''; }"]
    inside = ["don't", '"', "{", "}", "[", "r#\"", "//", "// x\n", "'\"'", "\\", "*", "\n", "fn no() {}"]

    def comment(depth):
        word = lambda: " " + rng.choice(inside) + " "
        return "/*" + word() + (comment(depth - 1) if depth > 1 else "") + word() + "*/"

    rows = []
    for k in range(120):
        deep, plain = [], []
        for n in range(rng.randrange(1, 7)):
            text = rng.choice(around) % n + "\n"
            own = comment(rng.choice([1, 3, 17, 18, 30])) if rng.random() < 0.6 else ""
            deep += [own, "\n", text]
            plain += ["/* x */" if own else "", "\n", text]
        rows.append((k, "".join(deep), "".join(plain)))
    df = spark.createDataFrame(rows, "k int, deep string, plain string")
    parts = lambda c: F.struct(rs.exports(F.col(c)), rs.types(F.col(c)), rs.imports(F.col(c)), F.transform(rs.functions(F.col(c)), lambda f: F.struct(f["name"], f["signature"], f["body"])), rs.is_balanced(F.col(c)))
    got = df.select("deep", parts("deep").alias("a"), parts("plain").alias("b")).collect()
    assert [r["deep"] for r in got if r["a"] != r["b"]] == []
    assert sum(len(r["a"][3]) for r in got) > 100


def test_what_deep_comments_print_is_whole(spark):
    doc = "/** " + "/* " * 20 + "x" + " */" * 20 + " */"
    row = spark.createDataFrame([(doc + "\nstruct S;\nfn f() { g(); " + "/* " * 20 + " */" * 20 + " }",)], "content string").select(
        rs.types(F.col("content")).alias("t"), rs.functions(F.col("content"), "block").alias("f")).head()
    assert row["t"] == ['# [doc = "' + doc[3:-2] + '"] struct S ;']
    assert row["f"][0]["body"] == "{ g(); " + "/* " * 20 + " */" * 20 + " }"
