"""Source divergence audit: term counts by length-bucketed packing, compared between the sources of a language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codescope.llm.common import salted_join, write_through

#: Bytes of text that a task sorts at once (or one text).
CHUNK = 8 << 20
#: Numbers (terms x sources) of a block of terms that one call compares.
CELLS = 1 << 17
#: p is counted in units of 1/SCALE; each occurrence count is raised by RAISE.
SCALE, RAISE = 1_000_000_000, 2

_COUNTS = "lang string, source string, term string, n long, docs long"

#: Bytes of a term, lower-cased; 0 for all others. Every byte above ASCII is part of a term.
_FOLD = np.zeros(256, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _bounds_and_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return bounds, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _radix(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``order`` stably re-sorted by ``words[order]``, 16 bits a pass, the last ones first."""
    for shift in (0, 16, 32, 48):
        digit = ((words >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        if len(digit) and (digit != digit[0]).any():
            order = order[np.argsort(digit[order], kind="stable")]  # a radix sort at this width
    return order


def _runs(keys: list[np.ndarray], group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, documents) of each run of equal keys and group; documents follow each other in a run."""
    n = len(group)
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for key in [*keys, group]:
        fresh[1:] |= key[1:] != key[:-1]
    first = fresh.copy()
    first[1:] |= doc[1:] != doc[:-1]
    start = np.flatnonzero(fresh)
    docs = np.add.reduceat(first.astype(np.int64), start) if n else start
    return start, np.diff(np.append(start, n)), docs


def count_terms(texts: list[pa.Array], group: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(group, term, occurrences, documents) of texts in the order of their groups, a batch for each bucket of lengths.

    Terms of up to 8 bytes are one 64-bit word, of up to 16 two: they are radix-sorted and their runs counted.
    Longer ones go to buckets of up to 32, 64, 128 ... bytes, each sorted as byte strings of its width.
    """
    parts = []
    for column in texts:
        bounds, data = _bounds_and_bytes(column)
        parts.append((np.diff(bounds), _FOLD[data[bounds[0] : bounds[-1]]]))
    sizes = np.concatenate([p[0] for p in parts])
    data = np.concatenate([*(p[1] for p in parts), np.zeros(16, np.uint8)])
    ends = np.cumsum(sizes)
    part_of = data != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = edge[0] = True
    starts = np.flatnonzero(part_of & (np.concatenate([[True], ~part_of[:-1]]) | edge[:-1]))
    stops = np.flatnonzero(part_of & (np.concatenate([~part_of[1:], [True]]) | edge[1:])) + 1
    length = stops - starts
    doc = np.searchsorted(ends, starts, "right").astype(np.int32)
    window = np.ndarray(len(data) - 7, ">u8", data.tobytes(), strides=(1,))  # the eight bytes from each place on

    def word(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        gone = (8 * (8 - size)).astype(np.uint64)
        return (window[at].astype(np.uint64) >> gone) << gone

    def terms(words: list[np.ndarray]) -> pa.Array:
        raw = np.stack(words, 1).astype(">u8").tobytes()
        fixed = np.frombuffer(raw, f"S{8 * len(words)}")  # no term has a zero byte, so the padding falls off
        return pa.array(fixed.tolist(), pa.binary())

    for low, high in ((0, 8), (8, 16)):
        pick = np.flatnonzero((length > low) & (length <= high))
        words = [word(starts[pick], np.minimum(length[pick], 8))]
        if high == 16:
            words.append(word(starts[pick] + 8, length[pick] - 8))
        order = np.arange(len(pick))
        for w in reversed(words):
            order = _radix(w, order)
        words, docs = [w[order] for w in words], doc[pick[order]]
        start, n, held = _runs(words, group[docs], docs)
        yield group[docs[start]], terms([w[start] for w in words]), n, held
    high = 16
    while len(length) and high < length.max():
        low, high = high, 2 * high
        pick = np.flatnonzero((length > low) & (length <= high))
        if len(pick):
            fixed = np.array([data[a:b].tobytes() for a, b in zip(starts[pick], stops[pick])], f"S{high}")
            order = np.argsort(fixed, kind="stable")
            fixed, docs = fixed[order], doc[pick[order]]
            start, n, held = _runs([fixed], group[docs], docs)
            yield group[docs[start]], pa.array(fixed[start].tolist(), pa.binary()), n, held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the rows of a task, a stretch of ``CHUNK`` bytes at a time; one row without term for each group."""

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        names = rows.group_by(["lang", "source"]).aggregate([([], "count_all")])
        number = {key: k for k, key in enumerate(zip(names["lang"].to_pylist(), names["source"].to_pylist()))}
        group = np.array([number[key] for key in zip(rows["lang"].to_pylist(), rows["source"].to_pylist())], np.int64)
        order = np.argsort(group, kind="stable")
        langs, sources = (names[c].combine_chunks().cast(pa.string()) for c in ("lang", "source"))
        zero = pa.array(np.zeros(len(number), np.int64))
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(number), pa.string()), zero, names["count_all"].combine_chunks().cast(pa.int64())], ["lang", "source", "term", "n", "docs"])
        texts = rows["text"].combine_chunks()
        chunks = texts.take(pa.array(order))
        for own, term, n, docs in count_terms(chunks.chunks if isinstance(chunks, pa.ChunkedArray) else [chunks], group[order]):
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays([langs.take(take), sources.take(take), term.cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(docs)], ["lang", "source", "term", "n", "docs"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = np.diff(_bounds_and_bytes(batch["text"])[0])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK - size, "right")) + at)
            held.append(batch.slice(at, to - at))
            size += int(sizes[at:to].sum())
            at = to
            if size >= CHUNK:
                yield from counted(held)
                held, size = [], 0
    if held:
        yield from counted(held)


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) without overflow, for totals below 9e15: three digits at a time."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return 1 + whole


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(top: int):
    """For a block of a language's terms: sums over them for each two sources, and each source's ``top`` terms."""

    def compare(counts: pa.Table, groups: pa.Table) -> pa.Table:
        sources = groups["source"].to_pylist()  # all of the language
        lang = groups["lang"][0].as_py()
        width = len(sources)
        place = {s: k for k, s in enumerate(sources)}
        kept = np.int64(groups["kept"][0].as_py())
        sizes = groups["n"].to_numpy()
        own = counts["term"].combine_chunks().dictionary_encode()
        term = own.indices.to_numpy(zero_copy_only=False)
        n = np.zeros((len(own.dictionary), width), np.int64)
        n[term, [place[s] for s in counts["source"].to_pylist()]] = counts["n"].to_numpy()
        p = shares(n + RAISE, (sizes + 2 * kept)[None, :])
        q = shares(n.sum(axis=1) + RAISE, sizes.sum() + 2 * kept)[:, None]
        first, second, value = [], [], []
        for k in range(width - 1):
            sums = divergence(p[:, k, None], p[:, k + 1 :]).sum(axis=0)
            first += [sources[k]] * len(sums) + sources[k + 1 :]
            second += sources[k + 1 :] + [sources[k]] * len(sums)
            value += [sums, sums]
        worth = np.where((n > 0) & (p > q), divergence(p, q), -1)
        names = own.dictionary.to_pylist()
        by_name = np.argsort(np.array([t.encode() for t in names], object), kind="stable")
        parts, terms, values = [], [], []
        for k in range(width):
            order = by_name[np.argsort(-worth[by_name, k], kind="stable")][:top]
            order = order[worth[order, k] >= 0]
            parts += [sources[k]] * len(order)
            terms += [names[i] for i in order]
            values.append(worth[order, k])
        return pa.table({
            "lang": pa.array([lang] * (len(first) + len(parts)), pa.string()),
            "source": pa.array(first + parts, pa.string()),
            "part": pa.array(["pair"] * len(first) + ["term"] * len(parts), pa.string()),
            "item": pa.array(second + terms, pa.string()),
            "value": pa.array(np.concatenate([*value, *values, np.zeros(0, np.int64)]).astype(np.int64)),
        })

    return compare


def count_by_source(spark: SparkSession, docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents that hold it; with a null term, all documents."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    return own.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit_sources(spark: SparkSession, docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and by which terms.

    A term is a stretch of letters A-Z and characters beyond ASCII, A-Z as a-z. A language keeps the V terms that ``least`` of its documents hold. A
    group (lang, source) with N occurrences of them gives each p = 1 + floor(1e9 * (count + 2) / (N + 2V)), the language likewise;
    two shares differ by f = floor((p - q)^2 / (p + q)). Part ``pair`` holds each other source of the language with the sum of f over all
    kept terms (0 without any), part ``term`` the ``top`` terms that the group has and with p above the language's q. Ranks
    go by value, then by item in UTF-8.

    Null text, lang and source count as empty; repeated rows are rows; other columns are ignored; no documents give no rows. Texts are
    counted where they are read; what is shuffled are counts. Terms are compared in blocks of at most ``CELLS`` numbers (one term at
    least), in which each pair's sum is taken over the block before sums are added up. Totals up to 9e15 terms are exact.
    """
    counts = write_through(spark, count_by_source(spark, docs), "counts")
    alike = Window.partitionBy("lang", "term")  # at most one row for each source of the language
    own = counts.where("term IS NOT NULL").withColumn("_in", F.sum("docs").over(alike)).where(F.col("_in") >= least)
    own = own.withColumn("first", (F.row_number().over(alike.orderBy("source")) == 1).cast("long"))
    kept = write_through(spark, own.select("lang", "source", "term", "n", "first"), "kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left")
    groups = write_through(spark, groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first", F.lit(0)).alias("first")), "groups")
    langs = groups.groupBy("lang").agg(F.sum("first").alias("kept"), F.count("*").alias("sources"))
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("sources") / CELLS)).cast("int"))
    langs = write_through(spark, langs, "langs")
    terms = salted_join(kept, langs, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term", "n")
    sides = groups.join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = sides.select("lang", "block", "source", "n", "kept")
    block = ["lang", "block"]
    compared = terms.groupBy(*block).cogroup(sides.groupBy(*block)).applyInArrow(_compare(top), "lang string, source string, part string, item string, value long")
    compared = write_through(spark, compared, "compared")
    pairs = compared.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = compared.where("part = 'term'")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(best)
