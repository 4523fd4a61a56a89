"""Chat formatting of reply trees, in built-in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codescope.functions.text import let, prefix_sum
from codescope.llm.common import write_through

# The template. A turn is HEAD role SPLIT text TAIL; inside roles and texts the escaped characters get a backslash
# before them, so HEAD, SPLIT and TAIL never occur there.
HEAD, SPLIT, TAIL = "### ", ": ", "</turn>\n"
_ESCAPED = r"([\\#<:])"
_TURN = r"(?s)### ((?:[^\\#<:]++|\\.)*+): ((?:[^\\#<:]++|\\.)*+)</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chains(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Plain conversations as reply trees: each turn answers the one before it (ties by role and text).

    tree, node, parent, role, text, score of ``reply_paths``; nodes count from 1 in each tree. Rows without a
    conversation are one conversation, rows without a turn come first.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    node = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    rows = rows.select("tree", node.alias("node"), "role", "text")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(spark: SparkSession, messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, place, node): the nodes of each chosen root-to-leaf path, place 0 at the root.

    Self-joins double the stretch that each node knows: after k of them, its ancestor 2^k up and the sum of scores on
    the way. Paths rank by mean score, ties to the smaller leaf; the ``best`` of each tree are taken (all
    if None). Then the same jumps, from the longest down, list each chosen path's nodes, each once. Depth d
    takes about 2 log2 d joins, and no array grows along a path.

    A tree's nodes are unique; a null tree is a tree. A parent that is null or absent makes a root. Nodes on a cycle
    have no root and take no part. A null score counts 0.
    """
    own = messages.select(F.struct("tree", "node").alias("at"), F.when(F.col("parent").isNotNull(), F.struct("tree", F.col("parent").alias("node"))).alias("up"), F.coalesce("score", F.lit(0.0)).alias("score"))
    known = own.select(F.col("at").alias("up"), F.lit(True).alias("known"))
    own = own.join(known, "up", "left").select("at", F.when(F.col("known"), F.col("up")).alias("up"), F.lit(1).cast("long").alias("depth"), "score")
    jumps = [write_through(spark, own, "jump")]
    left = jumps[0].where("up IS NOT NULL").count()
    while left:
        last = jumps[-1]
        far = last.select(F.col("at").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"), F.col("score").alias("gain"))
        step = last.join(far, "up", "left").select("at", F.col("far").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"))
        step = write_through(spark, step, "jump")
        left, before = step.where("up IS NOT NULL").count(), left
        if left == before:  # only nodes on or below a cycle still have an ancestor
            break
        jumps.append(step)
    ends = jumps[-1].where("up IS NULL")
    parents = own.where("up IS NOT NULL").select(F.col("up").alias("at")).distinct()
    leaves = ends.join(parents, "at", "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(W.partitionBy("at.tree").orderBy(F.desc(F.col("score") / F.col("depth")), "at.node")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    paths = write_through(spark, ranked.select(F.col("at").alias("leaf"), "rank", "depth", "at", F.lit(0).cast("long").alias("above")), "paths")
    for k in reversed(range(len(jumps) - 1)):
        hop = jumps[k].where("up IS NOT NULL").select("at", "up")
        more = paths.join(hop, "at").select("leaf", "rank", "depth", F.col("up").alias("at"), (F.col("above") + (1 << k)).alias("above"))
        paths = write_through(spark, paths.unionByName(more), "paths")
    return paths.select("leaf.tree", F.col("leaf.node").alias("leaf"), "rank", (F.col("depth") - 1 - F.col("above")).alias("place"), "at.node")


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): each path as one text, and the spans under the loss mask.

    ``loss`` holds (turn, start, length) of the escaped text of each assistant turn: the turn's number from 0, and code points of
    ``formatted``. A formatted conversation is one row, as long as its turns together.
    """
    body = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    path = paths.withColumnRenamed("tree", "_tree").withColumnRenamed("node", "_node")
    rows = path.join(body, F.expr("_tree <=> tree AND _node = node")).select("tree", "leaf", "rank", "place", "role", "text")
    head = F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(SPLIT))
    rows = rows.select("tree", "leaf", "rank", "place", F.concat(head, "text", F.lit(TAIL)).alias("turn"), F.length(head).alias("skip"), F.length("text").alias("size"), (F.col("role") == "assistant").alias("learn"))
    before = F.sum(F.length("turn").cast("long")).over(W.partitionBy("tree", "leaf").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.coalesce(before, F.lit(0)) + F.col("skip"))
    kept = F.sort_array(F.collect_list(F.struct("place", "turn", "learn", "start", "size"))).alias("turns")
    whole = rows.groupBy("tree", "leaf", "rank").agg(kept)
    spans = F.transform("turns", lambda t, i: F.when(t["learn"], F.struct(i.alias("turn"), t["start"].alias("start"), t["size"].alias("length"))))
    loss = F.filter(spans, lambda s: s.isNotNull())
    return whole.select("tree", "leaf", "rank", F.array_join("turns.turn", "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns (role, text) parsed from the text and learned, the unescaped text under the loss mask.

    The text is cut at its turns once; a span of the mask is taken from its own turn, so a conversation takes time in
    proportion to its length.
    """
    group = lambda g: F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(g))
    turns = F.transform(F.arrays_zip(group(1).alias("r"), group(2).alias("t")), lambda x: F.struct(unescape(x["r"]).alias("role"), unescape(x["t"]).alias("text")))

    def learned(whole: Column) -> Column:
        ends = prefix_sum(F.transform(whole, F.length))
        return let(ends, lambda end: F.transform("loss", lambda s: let(F.get(whole, s["turn"]), lambda own: unescape(F.substr(own, (s["start"] + 1 - F.get(end, s["turn"]) + F.length(own)).cast("int"), s["length"])))))

    return formatted.withColumn("turns", turns).withColumn("learned", F.array_join(let(group(0), learned), ""))


def conversation_digests(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Counts and digests of all conversations, read back from the formatted text."""
    messages = write_through(spark, chains(turns), "messages")
    back = read_back(format_paths(reply_paths(spark, messages), messages))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
