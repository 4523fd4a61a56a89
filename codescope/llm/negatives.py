"""Hard-negative mining with rotated one-bit codes and exact interval filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codescope.llm.common import batches_of, scratch_folder, write_through

#: Bytes of the integer vectors in a block of rows, and rows in it, at most (one row at least).
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 8192
#: Bytes of the integer vectors of the anchors that one round sends to every task: the bound of what is broadcast.
ROUND_BYTES = 32 << 20
#: Pairs whose intervals a task holds at once.
PAIRS = 1 << 20
#: One-bit codes of a vector, each of what the codes before leave over, and bit planes of an anchor.
CODES, PLANES = 3, 5

_ROWS = "dim int, ids binary, labels binary, values binary, signs binary, along binary, rest binary, norm binary"
_rotations: dict[int, np.ndarray] = {}


def labelled(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, v array<long>): each component x as floor(scale * x), x as double.

    Rows without id, label or vector, or with a null, NaN or infinite component, are left out.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    fit = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fit)
    return own.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _rotation(dim: int) -> np.ndarray:
    """The same random orthogonal matrix in every task."""
    if dim not in _rotations:
        _rotations[dim] = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]
    return _rotations[dim]


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits of each row as 64-bit words."""
    rows, dim = bits.shape
    packed = np.zeros((rows, -(-dim // 64) * 8), np.uint8)
    packed[:, : -(-dim // 8)] = np.packbits(bits, axis=1)
    return packed.view(np.uint64)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signs (rows, CODES, words), along (rows, CODES), rest, norm) of integer vectors.

    Code k is the signs of what is left of the rotated vector, ``along`` that remainder's length along the unit
    vector of the code (its alignment); the next code gets the remainder less that share. ``rest`` is the length of the last remainder.
    """
    left = values.astype(np.float64) @ _rotation(values.shape[1]).T
    root = np.sqrt(values.shape[1])
    signs, along = [], []
    norm = np.linalg.norm(left, axis=1)
    for _ in range(CODES):
        up = left >= 0
        unit = np.where(up, 1 / root, -1 / root)
        along.append((left * unit).sum(axis=1))
        signs.append(_words(up))
        left = left - along[-1][:, None] * unit
    return np.stack(signs, 1), np.stack(along, 1), np.linalg.norm(left, axis=1), norm


class Asked:
    """A block of anchors, rotated and cut into bit planes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.labels, self.values = ids, labels, values
        turned = values.astype(np.float64) @ _rotation(values.shape[1]).T
        self.low = turned.min(axis=1)
        step = (turned.max(axis=1) - self.low) / (2**PLANES - 1)
        self.step = np.where(step > 0, step, 1.0)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        near = self.low[:, None] + self.step[:, None] * level
        self.total = level.sum(axis=1)
        self.planes = [_words((level >> b) & 1 == 1) for b in range(PLANES)]
        self.length = np.linalg.norm(near, axis=1)
        self.off = np.linalg.norm(turned - near, axis=1)

    def interval(self, part: slice, signs: np.ndarray, along: np.ndarray, rest: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products of the anchors of ``part`` with encoded rows.

        Popcounts of plane and code give the product of the levelled anchor with each code. What the codes leave over is
        orthogonal to the last of them, so by Cauchy-Schwarz it adds at most its length times that of the anchor beside that code;
        the levelling adds at most its error times the row's length.
        """
        root = np.sqrt(self.values.shape[1])
        low, step, total = self.low[part, None], self.step[part, None], self.total[part, None]
        middle = 0.0
        for k in range(CODES):
            hits = np.zeros((low.shape[0], len(rest)), np.int64)
            for b, plane in enumerate(self.planes):
                for w in range(signs.shape[2]):
                    hits += np.bitwise_count(plane[part, w][:, None] & signs[None, :, k, w]).astype(np.int64) << b
            ones = np.bitwise_count(signs[:, k]).sum(axis=1, dtype=np.int64)[None, :]
            along_code = (low * (2 * ones - self.values.shape[1]) + step * (2 * hits - total)) / root
            middle = middle + along[None, :, k] * along_code
        beside = np.sqrt(np.maximum(self.length[part, None] ** 2 - along_code**2, 0.0))
        slack = beside * rest[None, :] + self.off[part, None] * norm[None, :]
        slack = slack * (1 + 1e-9) + 1e-9 * self.length[part, None] * norm[None, :] + 1e-6  # rounding of doubles
        return middle - slack, middle + slack


class Lists:
    """The ``k`` best (score, id) of each of ``size`` keys: larger scores first, ties to the smaller id."""

    def __init__(self, size: int, k: int) -> None:
        self.k = k
        self.key = self.score = self.id = np.zeros(0, np.int64)
        self.last = np.full(size, -np.inf)  # the kth score, once there are k

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        keep = rank < self.k
        full = rank == self.k - 1
        self.last[key[full]] = score[full]
        self.key, self.score, self.id = key[keep], score[keep], ids[keep]


def _packed(rows: DataFrame, coded: bool) -> DataFrame:
    """Rows of one dimension packed into blocks by the tasks that read them; with their codes if ``coded``."""

    def block(dim: int, ids: list, labels: list, values: list) -> pa.RecordBatch:
        v = np.array(values, "<i8").reshape(len(ids), dim)
        columns = {"dim": pa.array([dim], pa.int32())}
        parts = {"ids": np.array(ids, "<i8"), "labels": np.array(labels, "<i8"), "values": v}
        if coded:
            parts |= zip(("signs", "along", "rest", "norm"), encode(v))
        return pa.RecordBatch.from_pydict(columns | {name: pa.array([x.tobytes()], pa.binary()) for name, x in parts.items()})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            for i, label, v in zip(batch["vec_id"].to_pylist(), batch["label"].to_pylist(), batch["v"]):
                x = np.asarray(v.values)
                x = x if len(x) else np.zeros(1, np.int64)  # no components: all products are 0
                own = held.setdefault(len(x), ([], [], []))
                own[0].append(i), own[1].append(label), own[2].append(x)
                if len(own[0]) >= max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * len(x)))):
                    yield block(len(x), *held.pop(len(x)))
        for dim in list(held):
            yield block(dim, *held.pop(dim))

    return rows.select("vec_id", "label", "v").mapInArrow(pack, _ROWS if coded else "dim int, ids binary, labels binary, values binary")


def _array(value: pa.Scalar, dtype: str, *shape: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype).reshape(*shape) if shape else np.frombuffer(value.as_buffer(), dtype)


def _coded_blocks(batches: Iterator[pa.RecordBatch]):
    """(dim, ids, labels, values, codes) of each block of rows."""
    for batch in batches:
        for k in range(batch.num_rows):
            dim, ids = batch["dim"][k].as_py(), _array(batch["ids"][k], "<i8")
            codes = (_array(batch["signs"][k], "<u8", len(ids), CODES, -(-dim // 64)), _array(batch["along"][k], "<f8", len(ids), CODES), _array(batch["rest"][k], "<f8"), _array(batch["norm"][k], "<f8"))
            yield dim, ids, _array(batch["labels"][k], "<i8"), _array(batch["values"][k], "<i8", len(ids), dim), codes


def _products(q: np.ndarray, place: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Integer inner products of listed pairs."""
    out = np.empty(len(place), np.int64)
    step = max(1, PAIRS // q.shape[1])
    for i in range(0, len(place), step):
        out[i : i + step] = (q[place[i : i + step]] * v[at[i : i + step]]).sum(axis=1)
    return out


def _listed(tile: int, lists: Lists, per: int) -> pa.RecordBatch:
    n = len(lists.key)
    return pa.RecordBatch.from_pydict({"tile": pa.array(np.full(n, tile, np.int64)), "place": pa.array(lists.key // per), "slot": pa.array(lists.key % per), "id": pa.array(lists.id), "score": pa.array(lists.score)})


_LISTED = "tile long, place long, slot long, id long, score long"


def _positives(tiles, k: int):
    """Pass over all rows: each anchor's ``k`` best rows of its label in this task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {t: (dim, Asked(*own)) for t, dim, *own in tiles.value}
        best = {t: Lists(len(own.ids), k) for t, (_, own) in asked.items()}
        for dim, ids, labels, values, codes in _coded_blocks(batches):
            for t, (own_dim, own) in asked.items():
                step = max(1, PAIRS // len(ids))
                for i in range(0, len(own.ids) if dim == own_dim else 0, step):
                    part = slice(i, i + step)
                    fit = (own.labels[part, None] == labels[None, :]) & (own.ids[part, None] != ids[None, :])
                    low, high = own.interval(part, *codes)
                    need = best[t].last[part].copy()
                    new = np.flatnonzero(np.isneginf(need))
                    if len(new) and len(ids) > k:  # no list yet: the kth largest lower bound of this block will do
                        need[new] = np.partition(np.where(fit[new], low[new], -np.inf), len(ids) - k, axis=1)[:, len(ids) - k]
                    place, at = np.nonzero(fit & (high >= need[:, None]))
                    best[t].add(place + i, _products(own.values[part], place, values, at), ids[at])
        for t, own in best.items():
            yield _listed(t, own, 1)

    return search


def _negatives(tiles, windows, k: int, slots: int):
    """Pass over all rows: for each anchor and positive the ``k`` best rows of other labels inside its window of scores."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {t: (dim, Asked(*own)) for t, dim, *own in tiles.value}
        best = {t: Lists(len(own.ids) * slots, k) for t, (_, own) in asked.items()}
        for dim, ids, labels, values, codes in _coded_blocks(batches):
            for t, (own_dim, own) in asked.items():
                floor, ceiling = windows.value[t]
                step = max(1, PAIRS // len(ids))
                for i in range(0, len(own.ids) if dim == own_dim else 0, step):
                    part = slice(i, i + step)
                    low, high = own.interval(part, *codes)
                    need = np.maximum(floor[part], best[t].last.reshape(-1, slots)[part])
                    maybe = np.zeros(low.shape, bool)
                    for j in range(slots):
                        maybe |= (high >= need[:, j, None]) & (low <= ceiling[part, j, None])
                    place, at = np.nonzero(maybe & (own.labels[part, None] != labels[None, :]))
                    score = _products(own.values[part], place, values, at)
                    for j in range(slots):
                        inside = (score >= floor[part][place, j]) & (score <= ceiling[part][place, j])
                        best[t].add((place[inside] + i) * slots + j, score[inside], ids[at[inside]])
        for t, own in best.items():
            yield _listed(t, own, slots)

    return search


def _first(listed: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of all tasks' lists, ranked from 1."""
    order = Window.partitionBy("tile", "place", "slot").orderBy(F.desc("score"), "id")
    return listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    spark: SparkSession, vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchors`` selects.

    ``vectors`` are (vec_id, label, v array<long>) without nulls, as of ``labelled``. Scores are integer inner products, larger
    ones first, ties to the smaller id. A positive is one of the first ``positives`` rows of the anchor's label and another id;
    its negatives are the first ``negatives`` rows of other labels with
    low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score.

    Rows are encoded once, in place, and never shuffled: rounds of anchors of at most ``ROUND_BYTES`` go to every task. Intervals from
    popcounts leave out rows that cannot be among the best; all others are scored in integers, so results are exact. A task
    sends at most the best of each anchor, whatever it reads. Vectors of different lengths are never compared. Fewer rows
    than asked for are returned where there are no more. Repeated rows are rows, repeated anchors are answered each; empty tables give none.
    Scores must fit 64 bits.
    """
    rows = write_through(spark, _packed(vectors, True), "coded")
    chosen = write_through(spark, vectors.where(anchors), "anchors")
    chosen = chosen.repartition(max(1, -(-chosen.count() // BLOCK_ROWS)))
    tiles = write_through(spark, _packed(chosen, False).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    sizes = sorted(map(tuple, tiles.select("tile", F.length("values")).collect()))  # one row for thousands of anchors
    rounds: list[list[int]] = [[]]
    held = 0
    for tile, size in sizes:
        if held + size > ROUND_BYTES and rounds[-1]:
            rounds.append([])
            held = 0
        rounds[-1].append(tile)
        held += size
    out = scratch_folder(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    context = spark.sparkContext
    with batches_of(spark, 4):
        for turn, own in enumerate(rounds):
            blocks = []
            for row in tiles.where(F.col("tile").isin(own)).collect():  # ROUND_BYTES at most, or one block
                ids = np.frombuffer(row["ids"], "<i8")
                blocks.append((row["tile"], row["dim"], ids, np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["values"], "<i8").reshape(len(ids), row["dim"])))
            sent = context.broadcast(blocks)
            found = write_through(spark, _first(rows.mapInArrow(_positives(sent, positives), _LISTED), positives), "positives")
            windows = {t: (np.full((len(ids), positives), np.iinfo(np.int64).max), np.full((len(ids), positives), np.iinfo(np.int64).min)) for t, _, ids, *_ in blocks}
            for t, place, score, rank in found.select("tile", "place", "score", "rank").collect():  # a few numbers for each of the round's anchors
                windows[t][0][place, rank - 1] = -(-low_percent * score // 100)
                windows[t][1][place, rank - 1] = high_percent * score // 100
            bounds = context.broadcast(windows)
            best = _first(rows.mapInArrow(_negatives(sent, bounds, negatives, positives), _LISTED), negatives)
            names = spark.createDataFrame([(t, k, i) for t, _, ids, *_ in blocks for k, i in enumerate(ids.tolist())], "tile long, place long, anchor_id long")
            pairs = found.select("tile", "place", (F.col("rank") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, ["tile", "place"])
            mined = best.join(pairs, ["tile", "place", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            mined.write.parquet(f"{out}/round={turn}")
            sent.unpersist()
            bounds.unpersist()
    return spark.read.schema(schema).parquet(*[f"{out}/round={turn}" for turn in range(len(rounds))])
