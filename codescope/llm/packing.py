"""Best-fit packing of token sequences by bin completion (branch and bound over a size histogram)."""

from __future__ import annotations

import re
import sys
import types
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codescope.llm.common import batches_of, write_through

CAPACITY = 2048
END = 0
#: Pieces of text whose ids a worker remembers before it starts anew (memory only, never the result).
REMEMBERED = 500_000
#: Steps of the search for a plan better than best fit, at most (some microseconds each, on the driver); best fit needs none.
STEPS = 200_000
#: Ranks of one length are counted in so many parts.
PARTS = 256

# How the byte-level vocabulary splits a text, for texts of the characters in _PLAIN;
# the others are split by the tokenizer itself.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_SPLIT = rf"'(?:[sdmt]|ll|ve|re)| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+"
_PLAIN = rf"[\t\n\r\x20-\x7e{_LATIN}]*"
_SPECIAL = "<|endoftext|>"


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Ids(dict):
    """Piece of text -> its ids as little-endian 32-bit values."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        self[piece] = ids = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return ids


class Encoder:
    """Ids of a text by a byte-level BPE file of the ``tokenizers`` library, without special tokens added."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.ids = _Ids(self.whole.model)
        self.split, self.plain = re.compile(_SPLIT).findall, re.compile(_PLAIN).fullmatch

    def __call__(self, text: str) -> bytes:
        if self.plain(text) and _SPECIAL not in text:
            return b"".join(map(self.ids.__getitem__, self.split(text)))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def of(path: str) -> Encoder:
        """One for each worker process, whichever task it runs."""
        state = sys.modules.setdefault("_codescope_worker", types.ModuleType("_codescope_worker"))
        found = state.__dict__.setdefault("encoders", {})
        if path not in found:
            found[path] = Encoder(path)
        return found[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut only beyond ``capacity``.

    All pieces but the first are full. Null text counts as empty and gives the end id alone; ids of
    documents may be null or repeated; each row gives its own pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder.of(tokenizer), np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for k, text in enumerate(batch["text"]):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    part = ids[4 * a : 4 * b]
                    rows.append((k, piece, a, b - a, zlib.crc32(part), part if with_ids else None))
            if rows:
                of, *columns, parts = zip(*rows)
                arrays = [batch["doc_id"].take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(p, "<i4") for p in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
        encode.ids.clear()  # the worker outlives the task, and other stages run in it
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


Pattern = tuple[tuple[int, int], ...]  # (size, items of it) of one bin


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing as patterns (pattern, times): each item, largest first, into the fullest bin that holds it.

    Items of one size go together, as do bins of one content, so the work depends on the number of sizes only.
    """
    rooms: dict[int, list[tuple[Pattern, int]]] = {}
    for size in np.flatnonzero(counts)[::-1].tolist():
        items = int(counts[size])
        while items:
            room = min((r for r in rooms if r >= size), default=None)
            pattern, times = rooms[room].pop() if room is not None else ((), items)
            if room is not None and not rooms[room]:
                del rooms[room]
            room = capacity if room is None else room
            # A bin stays the fullest that fits until it does not: it takes as many as it holds.
            each = room // size
            full = min(times, items // each)
            spare = items - full * each if full < times else 0
            spare = min(spare, each - 1) if spare else 0
            for k, n in ((each, full), (spare, 1 if spare else 0)):
                if n:
                    rooms.setdefault(room - k * size, []).append(((*pattern, (size, k)), n))
            if pattern and (rest := times - full - (1 if spare else 0)):
                rooms.setdefault(room, []).append((pattern, rest))
            items -= full * each + spare
    return [held for room in sorted(rooms) for held in rooms[room]]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The most of the bounds of Martello and Toth: items above capacity - k stand alone, of those above half each needs a bin, and the rest (from k on) fills what they leave."""
    size = np.arange(len(counts))
    items, volume = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * size)])
    best = -(-int(volume[-1]) // capacity)
    half = capacity // 2
    for k in [0, *np.flatnonzero(counts[: half + 1]).tolist()]:
        alone, large = int(items[-1] - items[capacity - k + 1]), int(items[capacity - k + 1] - items[half + 1])
        beside = large * capacity - int(volume[capacity - k + 1] - volume[half + 1])
        best = max(best, alone + large + max(0, -(-(int(volume[half + 1] - volume[k]) - beside) // capacity)))
    return best


def fillings(left: np.ndarray, room: int, allowed: int) -> Iterator[tuple[int, Pattern] | None]:
    """Undominated fillings (waste, pattern) of ``room`` from the counted sizes that waste at most ``allowed``; None after each other step.

    Dominated are fillings to which an item can be added, and those in which a left-over item fits in the place of a
    smaller one. Larger items go first.
    """
    sizes = np.flatnonzero(left[: room + 1])[::-1].tolist()
    sizes = [s for s in sizes if s]
    have = [int(left[s]) for s in sizes]
    tail = np.append(np.cumsum([s * n for s, n in zip(sizes, have)][::-1])[::-1], 0).tolist()
    falling = [-s for s in sizes]
    stack: list[tuple[int, int, int, Pattern, int]] = [(0, room, room + 1, (), -1)]
    while stack:
        i, rest, skipped, chosen, k = stack.pop()
        if k < 0:  # to the next size that fits
            i = max(i, bisect_left(falling, -rest))
            if i == len(sizes):
                if rest <= allowed and rest < skipped and not _swappable(left, chosen, rest):
                    yield rest, chosen
                else:
                    yield None
                continue
            if rest - tail[i] > allowed:
                yield None
                continue
            k = min(have[i], rest // sizes[i])
        most = min(have[i], rest // sizes[i])
        if k:
            stack.append((i, rest, skipped, chosen, k - 1))
        stack.append((i + 1, rest - k * sizes[i], skipped if k == most else min(skipped, sizes[i]), (*chosen, (sizes[i], k)) if k else chosen, -1))
        yield None


def _swappable(left: np.ndarray, chosen: Pattern, waste: int) -> bool:
    used = dict(chosen)
    return any(left[y] > used.get(y, 0) for s, _ in chosen for y in range(s + 1, min(s + waste + 1, len(left)))) if waste else False


def bin_completion(counts: np.ndarray, capacity: int, steps: int = STEPS) -> list[tuple[Pattern, int]]:
    """Patterns (pattern, times) that pack ``counts[size]`` items of each size into few bins of ``capacity``.

    Best-fit decreasing is the incumbent. Branch and bound then looks for one bin less: the largest item left is completed by
    every undominated filling, the least wasteful of a handful first, and a branch ends once its waste rules the target out. A filling
    is repeated while its items last, then, on the way back, less often, so that a step stands for many bins. Each better plan
    is the next incumbent. The search ends at the lower bound, when no branch is left (the plan is then optimal where no
    filling could be repeated more than eight times), or after ``steps``; the plan is never worse than best fit.
    """
    best = best_fit(counts, capacity)
    bound, total = lower_bound(counts, capacity), int((np.arange(len(counts)) * counts).sum())
    bins = sum(n for _, n in best)
    while bins > bound and steps > 0:
        found, steps = _fewer(counts, capacity, (bins - 1) * capacity - total, steps)
        if found is None:
            break
        best, bins = found, sum(n for _, n in found)
    return best


def _fewer(counts: np.ndarray, capacity: int, allowed: int, steps: int) -> tuple[list[tuple[Pattern, int]] | None, int]:
    """A plan that wastes at most ``allowed``, or None; and the steps that are left. An explicit stack, whatever the depth."""

    def branches(left: np.ndarray, waste: int) -> Iterator[tuple[Pattern, int, int] | None]:
        top = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[top] -= 1
        found: list[tuple[int, Pattern]] = []
        source, looked = fillings(rest, capacity - top, allowed - waste), 0
        while True:
            step = next(source, False)
            looked += 1
            if step:
                found.append(step)
            if step is False or len(found) == 32 or (looked >= 500 and found):
                for spill, filling in sorted(found, key=lambda f: (f[0], len(f[1]))):
                    own = dict(filling)
                    own[top] = own.get(top, 0) + 1
                    pattern = tuple(sorted(own.items(), reverse=True))
                    most = min(int(left[s]) // k for s, k in pattern)
                    for times in range(most, 0, -1) if most <= 8 else [most >> h for h in range(most.bit_length())]:
                        if waste + spill * times <= allowed:
                            yield pattern, times, spill
                found, looked = [], 0
            if step is False:
                return
            yield None

    left = counts.copy()
    if not left.any():
        return [], steps
    stack = [(left, 0, branches(left, 0))]
    plan: list[tuple[Pattern, int]] = []
    while stack and steps > 0:
        left, waste, ways = stack[-1]
        way = next(ways, False)
        steps -= 1
        if way is None:
            continue
        if way is False:
            stack.pop()
            if plan:
                plan.pop()
            continue
        pattern, times, spill = way
        left = left.copy()
        for s, k in pattern:
            left[s] -= k * times
        plan.append((pattern, times))
        if not left.any():
            return plan, steps
        stack.append((left, waste + spill * times, branches(left, waste + spill * times)))
    return None, steps


def _slots(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (size, first rank, items per bin, first bin, offset), sorted by size and rank."""
    rows, used, base = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for s, k in pattern:
            rows.append((s, used.get(s, 0), k, base, offset))
            used[s] = used.get(s, 0) + k * times
            offset += s * k
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "piece", "ids_crc32"), length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset: places in as few sequences of ``capacity`` as bin completion finds.

    The instance is its histogram of lengths: ``capacity`` counts, however many pieces there are. That
    alone reaches the driver, which plans patterns; tasks give each piece the place of its rank among equal lengths.
    Pieces are read twice: pass a written table. Lengths are 1 to ``capacity``; a null or other
    length raises. Equal rows are packed one by one. No pieces: no rows.
    """
    part = F.pmod(F.xxhash64(*(F.col(k) for k in key)), F.lit(PARTS)).cast("int")
    dealt = pieces.withColumn("_part", part)
    sums = dealt.groupBy(F.col(length).alias("_n"), "_part").agg(F.count("*").alias("_items"))
    sums = write_through(spark, sums, "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in sums.groupBy("_n").agg(F.sum("_items").alias("items")).collect():
        if row["_n"] is None or not 1 <= row["_n"] <= capacity:
            raise ValueError(f"a piece of length {row['_n']} cannot be packed into {capacity}")
        counts[row["_n"]] = row["items"]
    slots = spark.sparkContext.broadcast(_slots(bin_completion(counts, capacity)))

    before = W.partitionBy("_n").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_n", "_part", F.coalesce(F.sum("_items").over(before), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_n", F.col(length)).join(sums, ["_n", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.row_number().over(W.partitionBy("_n", "_part").orderBy(*key)) - 1)
    ranked = ranked.select(*pieces.columns, F.col("_n").cast("long").alias("_n"), F.col("_rank").cast("long").alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        at = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            n, rank = batch["_n"].to_numpy(), batch["_rank"].to_numpy()
            own = table[np.searchsorted(at, n << 44 | rank, "right") - 1]
            nth, copy = np.divmod(rank - own[:, 1], own[:, 2])
            arrays = [batch[c] for c in batch.schema.names[:-2]] + [pa.array(own[:, 3] + nth), pa.array(own[:, 4] + copy * n)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-2], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of pieces packed with their ids: at most ``capacity`` tokens a row."""
    own = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return own.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs ``docs``; see ``token_pieces`` and ``pack``. Texts are tokenised once, in small batches: a worker holds one of texts and what comes of it."""
    with batches_of(spark, 1000):
        pieces = write_through(spark, token_pieces(docs, tokenizer, capacity, id_col, text_col, with_ids), "pieces")
    return pack(spark, pieces, capacity)
