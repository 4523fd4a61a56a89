"""Mixing sources to target weights: temperature, bisected exponent, budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codescope.llm.common import write_through

#: Blocks that a source's documents are dealt into at least, and documents in a block on average at most; an epoch is an order of the blocks.
BLOCKS, BLOCK_ROWS = 256, 1 << 16
#: Sources that the driver plans for; more than that raise.
MOST_SOURCES = 100_000


def temperature_weights(shares: dict, exponent: float) -> dict:
    """Shares raised to ``exponent`` and normalised: 1 keeps them, 0 makes all equal."""
    raised = {s: p**exponent if p > 0 else 0.0 for s, p in shares.items()}
    total = math.fsum(raised.values())
    return {s: r / total for s, r in raised.items()} if total else raised


def entropy(weights: dict) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def most_repeats(shares: dict, exponent: float) -> float:
    """Passes over the most repeated source while the least repeated one is read once."""
    weights = temperature_weights(shares, exponent)
    rates = [weights[s] / p for s, p in shares.items() if p > 0]
    return max(rates) / min(rates) if rates else 1.0


def fit_exponent(shares: dict, target_entropy: float | None = None, repeats: float | None = None, steps: int = 80) -> float:
    """The least exponent in [0, 1] whose entropy is at most ``target_entropy`` and repetition at most ``repeats``.

    Both fall as the exponent grows, so each is found by bisection; 1 if a target is out of reach.
    """

    def least(over) -> float:
        low, high = 0.0, 1.0
        if not over(low):
            return low
        for _ in range(steps):
            middle = (low + high) / 2
            low, high = (middle, high) if over(middle) else (low, middle)
        return high

    found = [0.0]
    if target_entropy is not None:
        found.append(least(lambda a: entropy(temperature_weights(shares, a)) > target_entropy))
    if repeats is not None:
        found.append(least(lambda a: most_repeats(shares, a) > repeats))
    return max(found)


def _words(text: Column) -> Column:
    """Words of a text as its tokens, at least one, so that no document is free."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++"))).cast("long")


def mix_sources(spark: SparkSession, docs: DataFrame, target_entropy: float | None = None, repeats: float | None = 2.0, budget: int | None = None, seed: int = 7,
                source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` at target weights, each row once per pass over it, with mix_tokens, mix_pass, mix_block and mix_weight.

    The exponent of the sources' token shares is bisected to the targets. ``budget`` is the number of tokens to draw; None takes the
    least that reads every source in full at least once, so that no document is lost. Of a source, all
    documents are read floor(budget * weight / tokens) times, and in a last pass as many as the
    rest of its budget holds, not more. A pass is a permutation of the source's blocks, and of each block's
    documents, by hashes of seed, pass and id. mix_pass counts from 0; order by mix_pass, mix_block and a hash of the id to read.

    Sources are few (the driver plans weights from one row each); their documents are many, so
    budgets are cut block by block, and only within the block where a budget ends document by
    document. Null source is a source; null text has no words and counts one token, as does empty text. Repeated rows are
    rows. Columns named like the added ones are replaced.
    """
    added = ["mix_tokens", "mix_pass", "mix_block", "mix_weight"]
    own = docs.drop(*added)
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))  # null is a source of its own
    light = own.select(key.alias("_source"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.coalesce(_words(F.col(text_col)), F.lit(1)).alias("_tokens"))
    light = light.groupBy("_source", "_id", "_hash").agg(F.max("_tokens").alias("_tokens"), F.count("*").alias("_rows"))
    light = write_through(spark, light, "mix")
    totals = light.groupBy("_source").agg(F.sum(F.col("_tokens") * F.col("_rows")).alias("n"), F.count("*").alias("k")).limit(MOST_SOURCES + 1).collect()
    sums = {r["_source"]: r["n"] for r in totals}
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    dealt = spark.createDataFrame([(r["_source"], max(BLOCKS, -(-r["k"] // BLOCK_ROWS))) for r in totals], "_source string, _blocks long")
    light = light.join(F.broadcast(dealt), "_source").withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "_id", "_hash"), F.col("_blocks")).cast("int")).drop("_blocks")
    blocks = write_through(spark, light.groupBy("_source", "_block").agg(F.sum(F.col("_tokens") * F.col("_rows")).alias("_sum")), "blocks")
    total = sum(sums.values())
    shares = {s: n / total for s, n in sums.items()}
    weights = temperature_weights(shares, fit_exponent(shares, target_entropy, repeats))
    draw = budget if budget is not None else max((sums[s] / w for s, w in weights.items()), default=0)
    plan = []
    for s, w in weights.items():
        passes = draw * w / sums[s]
        whole = math.floor(passes + 1e-9)
        plan.append((s, w, whole, max(0, math.floor(draw * w + 1e-6) - whole * sums[s])))
    plan = spark.createDataFrame(plan, "_source string, mix_weight double, _whole long, _rest long")

    # The last, partial pass: blocks in the order of their hashes, up to the one where the budget ends.
    order = F.xxhash64(F.lit(seed), F.lit("pass"), "_whole", "_block")
    line = W.partitionBy("_source").orderBy(order, "_block")  # one row for each of a source's blocks
    cut = blocks.join(F.broadcast(plan), "_source").withColumn("_before", F.sum("_sum").over(line) - F.col("_sum"))
    cut = cut.select("_source", "_block", "mix_weight", "_whole", (F.col("_rest") - F.col("_before")).alias("_left"), "_sum")
    met = light.join(cut, ["_source", "_block"])
    inside = W.partitionBy("_source", "_block").orderBy(F.xxhash64(F.lit(seed), "_whole", "_id", "_hash"), "_id", "_hash")
    edge = met.where("_left > 0 AND _left < _sum").withColumn("_upto", F.sum(F.col("_tokens") * F.col("_rows")).over(inside))
    edge = edge.withColumn("_part", (F.col("_upto") <= F.col("_left")).cast("long")).drop("_upto")
    rest = met.where("NOT (_left > 0 AND _left < _sum)").withColumn("_part", (F.col("_left") >= F.col("_sum")).cast("long"))
    drawn = edge.unionByName(rest).withColumn("_times", F.col("_whole") + F.col("_part")).where("_times > 0")
    drawn = drawn.select(F.struct("_source", "_id", "_hash").alias("_key"), F.col("_tokens").alias("mix_tokens"), F.col("_block").alias("mix_block"), "mix_weight", "_times")
    keyed = own.select(F.struct(*own.columns).alias("row"), F.struct(key.alias("_source"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash")).alias("_key"))
    full = keyed.join(drawn, "_key").withColumn("mix_pass", F.explode(F.sequence(F.lit(0), (F.col("_times") - 1).cast("int"))))
    return full.select("row.*", *added)
