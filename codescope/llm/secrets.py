"""Secret scans with a trigram inverted index, in built-in column expressions only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.functions.text import let, prefix_sum
from codescope.llm.common import salted_join, write_through

#: Alternatives a stretch of a pattern may have before its trigrams count as unknown.
_MOST = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern for both Java and Python, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base kinds and their order in a row's digest.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36}"),
)


def _strings(parts) -> list[set[str] | None]:
    """For each part of a parsed pattern the few strings it stands for, lower-cased, or None."""
    out: list[set[str] | None] = []
    for op, arg in parts:
        name = str(op)
        if name == "LITERAL":
            out.append({chr(arg).lower()})
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            out.append({chr(c).lower() for _, c in arg})
        elif name == "SUBPATTERN":
            out += _strings(arg[-1])
        elif name == "BRANCH":
            ways = [_joined(_strings(way)) for way in arg[1]]
            out.append(None if None in ways else set().union(*ways))
        elif name == "MAX_REPEAT" and arg[0] <= 1 == arg[1] and (own := _joined(_strings(arg[2]))) is not None:
            out.append(own | {""} if arg[0] == 0 else own)
        else:
            if name == "MAX_REPEAT" and arg[0] > 0 and (own := _joined(_strings(arg[2]))) is not None and len(own) == 1:
                out.append({next(iter(own)) * arg[0]})
            out.append(None)
    return out


def _joined(strings: list[set[str] | None]) -> set[str] | None:
    found = {""}
    for s in strings:
        if s is None or len(found) * len(s) > _MOST:
            return None
        found = {a + b for a, b in product(found, s)}
    return found


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Trigrams of lower-cased texts that a match needs: an OR of ANDs; None if none is mandatory.

    Of the pattern's stretches of known strings the one with the most trigrams in its weakest
    alternative is asked for.
    """
    best: list[frozenset[str]] | None = None
    run: set[str] = {""}
    for part in [*_strings(re._parser.parse(pattern)), None]:
        grown = None if part is None else _joined([run, part])
        if grown is not None:
            run = grown
            continue
        query = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
        if min(map(len, query)) > (0 if best is None else min(map(len, best))):
            best = sorted(set(query), key=sorted)
        run = part if part is not None else {""}
    return best and [c for c in best if not any(d < c for d in best)]  # a weaker alternative stands for a stronger one


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc) for each distinct text, by hash, and each of ``trigrams`` it holds."""
    low = docs.select(F.xxhash64("text").alias("doc"), F.lower("text").alias("low"))
    found = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select(F.explode(found).alias("trigram"), "doc").distinct()


def candidates(spark: SparkSession, index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc, kinds) of texts that a rule with mandatory trigrams may match: postings intersected per alternative."""
    wanted = []
    for rule in rules:
        for k, grams in enumerate(trigram_query(rule.pattern) or ()):
            wanted += [(rule.kind, k, g, len(grams)) for g in sorted(grams)]
    clauses = spark.createDataFrame(wanted, "kind string, clause int, trigram string, size int")  # fixed by the rules
    hits = index.join(F.broadcast(clauses), "trigram").groupBy("doc", "kind", "clause", "size").agg(F.count("*").alias("held"))
    return hits.where("held = size").groupBy("doc").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches as (start, order, kind, end) in code points; failing ones dropped.

    Starts come from the lengths of the matches and of the stretches between them.
    """
    kind = "array<struct<start:int,rank:int,kind:string,end:int>>"
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found

    def placed(m: Column) -> Column:
        gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(m))
        starts = prefix_sum(F.transform(gaps, lambda g, i: F.length(g) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0)))
        rows = F.arrays_zip(starts.alias("at"), m.alias("m"), group.alias("g"))
        rows = F.filter(rows, lambda r: F.length(r["g"]) >= rule.least)
        return F.transform(rows, lambda r: F.struct(r["at"].alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), (r["at"] + F.length(r["m"])).alias("end")))

    none = F.array().cast(kind)
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m).cast(kind)))


def find_secrets(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): for each row the spans (start, rank, kind, end) of all rules, by start and rule.

    The index posts the trigrams that the rules ask for, for every text. Candidates of a rule are verified on the whole
    text; a rule without mandatory trigrams is verified on every text. Null text counts as empty. Equal texts are one
    entry of the index; repeated rows each keep a row.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in asked.values() if q for c in q for g in c})
    index = write_through(spark, postings(own, grams), "postings")
    flags = candidates(spark, index, rules)
    met = salted_join(own.withColumn("doc", F.xxhash64("text")), flags, "doc", "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    found = []
    for order, rule in enumerate(rules):
        maybe = F.array_contains("kinds", rule.kind) if asked[rule.kind] else F.rlike("text", F.lit(_long_enough(rule)))
        found.append(F.when(maybe, spans_of(F.col("text"), rule, order)).otherwise(none))
    return met.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("spans"))


def _long_enough(rule: Rule) -> str:
    """A pattern that every text with a kept match holds, to verify fewer: a class repeated at least ``least`` times."""
    return rule.pattern[:-1] + f"{{{rule.least}}}" if re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) else rule.pattern


def secret_digests(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of base rules, base_sha256 and spans as text of ``find_secrets``."""
    text = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    base = [r.kind for r in rules if r.base]
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    first = F.filter("spans", lambda x: x["rank"].isin([k for k, r in enumerate(rules) if r.base]))
    return found.select("doc_id", *counts, F.sha2(text(first), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
