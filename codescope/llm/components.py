"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm.common import salted_join, write_through

#: Nodes that a task joins at a time before it hands on what it has.
NODES = 1 << 18
#: Rounds in which a node hangs below its least neighbour, as stars do in one or two; the later ones go by hashes.
BY_NODE = 2


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges as (node, least node that they reach), a row for each of its nodes."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def found(schema: pa.Schema) -> pa.RecordBatch:
        nodes = list(up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, schema.field(0).type), pa.array([root(x) for x in nodes], schema.field(0).type)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            a, b = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            up[max(a, b)] = min(a, b)
        if len(up) >= NODES:
            yield found(batch.schema)
            up.clear()
    if up:
        yield found(batch.schema)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that links reach.

    Each task first turns its edges into stars. Each round then hangs every node below the least neighbour
    (or itself), from the third round on that of the least hash, with another
    hash each round, and contracts the edges; a constant share of the nodes goes per such round, also
    on long chains. Rounds go through written tables: each costs the driver several plans, whatever the number of edges,
    so that few rounds matter on small graphs. Loops and repeated edges do no harm; edges
    with a null end are left out.
    """
    clean = edges.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    kind = clean.schema["a"].dataType.simpleString()
    stars = write_through(spark, clean.mapInArrow(_stars, f"a {kind}, b {kind}").distinct(), "edges")
    left = stars.where("a <> b")
    roots = stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    turn = 0
    while not left.isEmpty():
        turn += 1
        rank = lambda c, seed=turn: F.struct((F.lit(0) if seed <= BY_NODE else F.xxhash64(F.lit(seed), F.col(c))).alias("rank"), F.col(c).alias("node"))
        both = left.select("a", "b").union(left.select(F.col("b"), F.col("a")))
        hung = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        hung = hung.select(F.col("a").alias("node"), F.least(rank("a"), F.col("near")).getField("node").alias("up"))
        hung = write_through(spark, hung, "hung")
        one = salted_join(left.withColumnRenamed("a", "node"), hung, "node").select(F.col("up").alias("a"), F.col("b").alias("node"))
        two = salted_join(one, hung, "node").select("a", F.col("up").alias("b"))
        left = write_through(spark, two.where("a <> b").distinct(), "edges")
        moved = salted_join(roots.withColumnRenamed("root", "r"), hung.withColumnRenamed("node", "r"), "r", "left")
        roots = write_through(spark, moved.select("node", F.coalesce("up", "r").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return salted_join(roots, least, "root").select("node", "component")
