"""Line deduplication with a log-template tree, in built-in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codescope.functions.text import let
from codescope.llm.common import salted_join, write_through

#: Tokens that lead to a leaf, after the token count.
DEPTH = 4
#: Lines of fewer tokens have no template with a variable stretch.
LONG = 12
#: Constant tokens that a template with variable fields needs, two thirds of its tokens at least, and texts that must share it.
CONSTANT, MANY = 8, 3
#: Lines of fewer tokens go only within a run of recurring lines that holds RUN tokens.
SHORT, RUN = 5, 20
_LAST = (1 << 63) - 1
_LINES = "array<struct<pos:int,tokens:int,whole:bigint,general:array<bigint>>>"


def _templates(line: Column, pos: Column) -> Column:
    """(pos, tokens, whole, general) of a line: a hash of all its tokens, and of its templates with variable fields."""

    def hashed(t: Column) -> Column:
        n = F.size(t)
        digits = F.rlike(line, F.lit("[0-9]"))
        masked = F.transform(t, lambda x: F.when(F.rlike(x, F.lit("[0-9]")), "<*>").otherwise(x))
        fields = lambda m: F.size(F.filter(m, lambda x: x == "<*>"))
        third = F.ceil((n - DEPTH) / 3).cast("int")
        tail = lambda m, k: F.slice(m, F.lit(DEPTH + 1) + third * k, third)

        def general(m: Column) -> Column:
            constant = n - F.when(digits, fields(m)).otherwise(0)
            enough = lambda c: (c >= CONSTANT) & (3 * c >= 2 * n)
            whole = F.when(digits & enough(constant), F.xxhash64(n, F.lit(-1), m))
            path = F.slice(m, F.lit(1), F.lit(DEPTH))
            # One stretch of the tokens behind the path is variable; the constants are counted without it.
            free = [F.when((n >= LONG) & enough(constant - third), F.xxhash64(n, F.lit(k), path, *(tail(m, j) for j in range(3) if j != k))) for k in range(3)]
            return F.array_compact(F.array(whole, *free))

        found = let(F.when(digits, masked).otherwise(t), general)
        return F.struct(pos.alias("pos"), n.alias("tokens"), F.xxhash64(n, t).alias("whole"), F.when(n >= CONSTANT, found).otherwise(F.array().cast("array<bigint>")).alias("general"))

    return let(F.split(F.btrim(line, F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+"), lambda t: F.when(F.get(t, F.lit(0)) != "", hashed(t)))


def line_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, lines) of each text: its lines with tokens and their templates.

    The path to a leaf is the token count and the first DEPTH tokens, with tokens that hold a digit as variable fields. In
    the leaf a line stands for the template of all its tokens and, from LONG tokens on, for three in which a third of
    the tokens behind the path is variable, each only with enough constant tokens. Lines without tokens have none.
    """
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    lines = F.filter(F.transform(F.split("text", "\n"), _templates), lambda x: x.isNotNull()).cast(_LINES)
    return own.select("doc", F.xxhash64("text").alias("text_hash"), lines.alias("lines"))


def _recurring(texts: DataFrame, templates: Column, many: int) -> DataFrame:
    """(template, first) of the templates that ``many`` texts and two documents have; a text counts once for each."""
    each = texts.select("doc", F.explode(F.array_distinct(templates)).alias("template"))
    seen = each.groupBy("template").agg(F.count("*").alias("times"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    return seen.where((F.col("first") < F.col("last")) & (F.col("times") >= many)).select("template", "first")


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with recurring lines dropped from the text, and lines_dropped (int).

    A line recurs if another document has its tokens in full, or if MANY texts of two documents or more share a template of it
    that has CONSTANT constant tokens and two thirds of all. The first document, of the smallest id, keeps its lines, so that no line is lost
    from the corpus; all others lose theirs. A line of fewer than SHORT tokens goes only in a run of recurring lines (blank ones
    aside) of RUN tokens in all: a heading or "Yes" alone stays. Lines end at a line feed.

    Null text stays null; rows of one id count as one document, rows without id together as the last one. All columns and
    rows stay, whatever their names; lines_dropped replaces a column of that name.
    """
    texts = write_through(spark, line_templates(docs, id_col, text_col), "templates")
    full = _recurring(texts, F.col("lines.whole"), 2)
    loose = _recurring(texts, F.flatten("lines.general"), MANY)
    recurring = full.unionByName(loose)
    lines = texts.select("doc", "text_hash", F.posexplode("lines").alias("ord", "line"))
    ways = F.concat(F.array("line.whole"), F.col("line.general"))
    met = salted_join(lines.select("doc", "text_hash", "ord", "line.pos", "line.tokens", F.explode(ways).alias("template")), recurring, "template", salts=4)
    hits = met.where("doc <> first").select("doc", "text_hash", "ord", "pos", "tokens").distinct()
    line = W.partitionBy("doc", "text_hash")
    hits = hits.withColumn("run", F.col("ord") - F.row_number().over(line.orderBy("ord")))
    hits = hits.withColumn("total", F.sum("tokens").over(W.partitionBy("doc", "text_hash", "run")))
    gone = hits.where((F.col("tokens") >= SHORT) | (F.col("total") >= RUN)).groupBy("doc", "text_hash").agg(F.collect_list("pos").alias("gone"))
    gone = gone.select(F.struct("doc", "text_hash").alias("key"), "gone")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text_col).alias("text_hash")).alias("key"))
    kept = F.filter(F.split(F.col(f"row.{text_col}"), "\n"), lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col(f"row.{text_col}")).otherwise(F.array_join(kept, "\n"))
    columns = [(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c != "lines_dropped"]
    return keyed.join(gone, "key", "left").select(*columns, F.coalesce(F.size("gone"), F.lit(0)).alias("lines_dropped"))
