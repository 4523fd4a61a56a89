"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm.common import batches_of, salted_join, write_through

#: Queries in a block and candidates in a block: a task holds one block of each, and their scores.
QUERY_BLOCK = 512
ROW_BLOCK = 2048
#: Bins of a histogram round; each round narrows a query's range of scores by this factor.
BINS = 64


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): each component x as floor(scale * x), x as double.

    Rows whose vector is null or holds null, NaN or an infinity are left out, as are rows without id.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fit = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fit).select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(block, dim, ids binary, values binary): rows packed into matrices of ``size`` rows of one dimension.

    A task packs what it reads; a block never spans tasks, so there is nothing to shuffle or to gather.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, values = held.pop(dim)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), "values": pa.array([np.array(values, "<i8").tobytes()], pa.binary())})

        for batch in batches:
            for i, v in zip(batch["vec_id"].to_pylist(), batch["v"]):
                values = np.asarray(v.values)
                own = held.setdefault(len(values), ([], []))
                own[0].append(i), own[1].append(values)
                if len(own[0]) == size:
                    yield block(len(values))
        for dim in list(held):
            yield block(dim)

    packed = rows.mapInArrow(pack, "dim int, ids binary, values binary")
    return packed.select(F.xxhash64("ids", "values", F.monotonically_increasing_id()).alias(name), "dim", "ids", "values")


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers: through doubles where these hold every partial sum exactly."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if bound < 2.0**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _matrix(row: dict, ids: str, values: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(row[ids].as_buffer(), "<i8")
    return own, np.frombuffer(row[values].as_buffer(), "<i8").reshape(len(own), dim)


def _pairs(batch: pa.RecordBatch):
    """Per row of (query block, candidate block): its columns, the ids and the scores, a query's own row masked."""
    for k in range(batch.num_rows):
        row = {c: batch[c][k] for c in batch.schema.names}
        dim = row["dim"].as_py()
        qid, q = _matrix(row, "qids", "qvalues", dim)
        cid, c = _matrix(row, "ids", "values", dim)
        yield row, qid, cid, _scores(q, c), qid[:, None] != cid[None, :]


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, qid, _, scores, other in _pairs(batch):
            low = np.where(other, scores, np.iinfo(np.int64).max).min(axis=1)
            high = np.where(other, scores, np.iinfo(np.int64).min).max(axis=1)
            n = other.sum(axis=1)
            yield pa.RecordBatch.from_pydict({"query": np.repeat([row["query"].as_py()], len(qid)), "place": np.arange(len(qid)), "low": low, "high": high, "n": n}).filter(pa.array(n > 0))


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each query the counts of its scores in BINS equal bins of its range of this round.

    The last bins may reach beyond the range; scores above its end were counted in an earlier round.
    """
    for batch in batches:
        for row, qid, _, scores, other in _pairs(batch):
            low, high, width = (np.frombuffer(row[c].as_buffer(), "<i8") for c in ("lows", "highs", "widths"))
            with np.errstate(over="ignore"):
                bins = np.floor_divide(scores - low[:, None], np.maximum(width, 1)[:, None])
            inside = other & (scores >= low[:, None]) & (scores <= high[:, None]) & (bins < BINS) & (width[:, None] > 0)
            place, _ = np.nonzero(inside)
            counts = np.bincount(place * BINS + bins[inside], minlength=len(qid) * BINS).reshape(len(qid), BINS)
            at, of = np.nonzero(counts)
            yield pa.RecordBatch.from_pydict({"query": np.repeat([row["query"].as_py()], len(at)), "place": at, "bin": of, "n": counts[at, of]})


def _best(k: int):
    """Scores at or above each query's kth value; of a block's ties, no more than can be among the first k."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, qid, cid, scores, other in _pairs(batch):
                low = np.frombuffer(row["lows"].as_buffer(), "<i8")
                place, at = np.nonzero(other & (scores >= low[:, None]))
                own = scores[place, at]
                order = np.lexsort((cid[at], -own, place))
                place, at, own = place[order], at[order], own[order]
                keep = np.arange(len(place)) - np.searchsorted(place, place) < k
                yield pa.RecordBatch.from_pydict({"query_id": qid[place[keep]], "place": place[keep], "query": np.repeat([row["query"].as_py()], keep.sum()), "vec_id": cid[at[keep]], "score": own[keep]})

    return best


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` rows of the largest inner product, ties to the smaller id.

    ``vectors`` and ``queries`` are (vec_id, v array<long>); a query never finds rows of its own id. Blocks of queries meet
    blocks of rows of the same dimension. Scores are never kept: a first pass finds each query's range, then rounds
    of histograms over all scores narrow it to the bin of the kth value, until that bin holds one
    value; a last pass returns the scores from there on. Each task sends at most ``k`` rows a query and block. Where fewer
    than ``k`` rows exist, all are returned. Repeated rows are rows; repeated query rows are answered each.
    """
    rows = write_through(spark, _blocks(vectors, ROW_BLOCK, "row"), "rows")
    queries = write_through(spark, queries, "asked")
    full = queries.repartition(max(1, -(-queries.count() // QUERY_BLOCK)))  # few full blocks, so rows are sent seldom
    asked = write_through(spark, _blocks(full, QUERY_BLOCK, "query").withColumnsRenamed({"ids": "qids", "values": "qvalues"}), "queries")
    sent = salted_join(rows, asked.select("dim", "query"), "dim")  # each block of rows once for each block of queries

    def meet(state: DataFrame | None) -> DataFrame:
        side = asked if state is None else asked.join(state, "query")
        return sent.join(side.drop("dim"), "query").repartition("row", "query")

    with batches_of(spark, 4):
        found = meet(None).mapInArrow(_range, "query long, place long, low long, high long, n long")
        state = found.groupBy("query", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        state = state.select("query", "place", "low", "high", F.ceil((F.col("high") - F.col("low") + 1) / BINS).cast("long").alias("width"), F.least(F.lit(k), F.col("n")).cast("long").alias("want"))
        state = write_through(spark, state, "state")

        def packed(state: DataFrame) -> DataFrame:
            """One row for each block of queries: its queries' ranges, in their places, as binaries."""
            own = state.groupBy("query").agg(F.collect_list(F.struct("place", "low", "high", "width")).alias("s"))  # at most QUERY_BLOCK

            def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for query, s in zip(batch["query"].to_pylist(), batch["s"].to_pylist()):
                        lows, highs, widths = np.full(QUERY_BLOCK, np.iinfo(np.int64).max, "<i8"), np.full(QUERY_BLOCK, np.iinfo(np.int64).min, "<i8"), np.zeros(QUERY_BLOCK, "<i8")
                        for x in s:
                            lows[x["place"]], highs[x["place"]], widths[x["place"]] = x["low"], x["high"], x["width"]
                        yield pa.RecordBatch.from_pydict({"query": pa.array([query], pa.int64()), "lows": pa.array([lows.tobytes()], pa.binary()), "highs": pa.array([highs.tobytes()], pa.binary()), "widths": pa.array([widths.tobytes()], pa.binary()), "size": pa.array([len(s)], pa.int32())})

            own = own.mapInArrow(fill, "query long, lows binary, highs binary, widths binary, size int")
            sizes = asked.select("query", F.expr("cast(length(qids) / 8 as int)").alias("held"))
            cut = lambda c: F.substr(c, F.lit(1), F.col("held") * 8).alias(c)
            return own.join(sizes, "query").select("query", cut("lows"), cut("highs"), cut("widths"))

        while not state.where("width > 0").isEmpty():
            counts = meet(packed(state)).mapInArrow(_histogram, "query long, place long, bin long, n long")
            counts = counts.groupBy("query", "place", "bin").agg(F.sum("n").alias("n"))
            bins = counts.groupBy("query", "place").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))  # at most BINS
            walk = F.aggregate("bins", F.struct(F.col("want").alias("want"), F.lit(-1).cast("long").alias("bin")),
                               lambda s, b: F.when(s["bin"] >= 0, s).when(b["n"] >= s["want"], F.struct(s["want"].alias("want"), b["bin"].alias("bin"))).otherwise(F.struct((s["want"] - b["n"]).alias("want"), s["bin"].alias("bin"))))
            at = state.join(bins, ["query", "place"], "left").withColumn("at", F.when(F.col("bins").isNotNull(), walk))
            narrow = F.when(F.col("width") > 1, F.ceil(F.col("width") / BINS)).otherwise(0).cast("long")
            low = F.when(F.col("width") > 0, F.col("low") + F.col("at.bin") * F.col("width")).otherwise(F.col("low"))
            at = at.withColumn("_low", low)
            high = F.when(F.col("width") > 0, F.col("_low") + F.least(F.col("high") - F.col("_low"), F.col("width") - 1)).otherwise(F.col("high"))  # the bin's last value
            state = write_through(spark, at.select("query", "place", F.col("_low").alias("low"), high.alias("high"), narrow.alias("width"), F.coalesce("at.want", "want").alias("want")), "state")

        hits = meet(packed(state)).mapInArrow(_best(k), "query_id long, place long, query long, vec_id long, score long")
        first = hits.groupBy("query", "place", "query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("all"))
        ranked = first.select("query_id", F.posexplode(F.slice("all", 1, k)).alias("rank", "hit"))
        return write_through(spark, ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score")), "top")
