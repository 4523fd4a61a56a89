"""N-gram Jaccard join by T-occurrence search over inverted lists (DivideSkip)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codescope.llm.common import batches_of, fold_chunks, salted_join, split_chunks, write_through
from codescope.llm.components import components
from codescope.llm.shingles import mix, shingle_sets, signature
from codescope.scratch import write_bucketed

#: Entries of each row of the sketch of list lengths, its rows, and the filter of wanted sets: fixed, whatever the corpus.
WIDTH = 1 << 20
ROWS = 3
WANTED = 1 << 22
CHUNKS = 96
#: Lists up to this length give pairs; longer ones go through tiles. Both ways are exact.
SHORT_LIST = 8
#: Lists estimated at this length or more are dealt by list and document.
HOT_LIST = 4096
#: Long lists of each set that are searched first; of the others only sets that may still link with another component.
EAGER = 1
#: Shingles in a block of a long list; a tile is two blocks.
BLOCK = 1 << 19


def need(n: np.ndarray | int, percent: int):
    """Overlap that any partner of a set of ``n`` must reach at least."""
    return -(-percent * n // 100)


def spare(n: int, percent: int) -> int:
    """Occurrences asked for on the short lists (T - L of DivideSkip)."""
    return 1 + (n - need(n, percent)) // 2


def links(shingles: int, other: int, shared: int, percent: int) -> bool:
    return 100 * shared >= percent * (shingles + other - shared)


def _sketched(shingles: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and signs of shingles in each row of the sketch.

    With signs the many lists of one entry cancel out instead of adding up: the error of an estimate is the root
    of what else is in its place.
    """
    return [((r << 20) + ((shingles >> np.uint64(44 - 20 * r)).astype(np.int64) & (WIDTH - 1)), ((shingles >> np.uint64(r)) & np.uint64(1)).astype(np.int32) * 2 - 1) for r in range(ROWS)]


def estimated_lengths(sketch: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Estimated list lengths, at least 1: the median over the rows."""
    return np.maximum(np.median([sketch[at] * sign for at, sign in _sketched(shingles)], axis=0), 1).astype(np.uint64)


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of all entries of the lists at ``starts`` with ``counts`` entries."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def t_occurrence(sets: list[np.ndarray], roles: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """Links among ``sets`` that connect what the links found so far do not: a spanning forest.

    Roles: 0 is indexed and searched for, 1 is indexed only, 2 is searched for only. For each set the
    short lists are merged, and candidates that occur ``T - L`` times there are probed in the long
    lists by binary search (merged instead where so many candidates are left that it costs less). Of
    each component the most promising candidates go first; once one links, the rest are skipped.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    indexed = [i for i in order if roles[i] != 2]
    if not indexed:
        return
    sizes = np.array([len(sets[i]) for i in indexed])
    place = {i: k for k, i in enumerate(indexed)}
    keys = np.concatenate([sets[i] for i in indexed])
    by = np.argsort(keys, kind="stable")  # within a list the owners ascend
    owner = np.repeat(np.arange(len(indexed)), sizes)[by]
    names, first, counts = np.unique(keys[by], return_index=True, return_counts=True)
    entry = np.repeat(np.arange(len(names)), counts) * len(indexed) + owner
    label = np.arange(len(indexed))
    outside = len(indexed)
    for x in order:
        if roles[x] == 1:
            continue
        n = len(sets[x])
        at = np.minimum(np.searchsorted(names, sets[x]), len(names) - 1)
        at = at[names[at] == sets[x]]
        at = at[np.argsort(counts[at], kind="stable")]
        least, asked = int(need(n, percent)), spare(n, percent)
        missing = n - len(at)  # empty lists are the shortest
        cut = max(0, n - least + asked - missing)
        short, long = at[:cut], at[cut:]
        found, times = np.unique(owner[_gather(first[short], counts[short])], return_counts=True)
        fit = (times >= asked) & (100 * np.minimum(sizes[found], n) >= percent * np.maximum(sizes[found], n))
        if roles[x] == 0:
            fit &= found < place[x]
        found, times = found[fit], times[fit]
        mine = label[place[x]] if roles[x] == 0 else outside + 1
        width = 1
        while len(found):
            fresh = label[found] != mine
            found, times = found[fresh], times[fresh]
            rank = np.lexsort((-times, label[found]))
            found, times = found[rank], times[rank]
            group = label[found]
            turn = np.arange(len(found)) - np.searchsorted(group, group)
            now = turn < width
            cand, total = found[now], times[now].copy()
            if len(long) * len(cand) * 32 < counts[long].sum():
                asked_for = (long[:, None] * len(indexed) + cand[None, :]).ravel()
                hit = entry[np.minimum(np.searchsorted(entry, asked_for), len(entry) - 1)] == asked_for
                total += hit.reshape(len(long), len(cand)).sum(axis=0)
            else:
                total += np.bincount(owner[_gather(first[long], counts[long])], minlength=len(indexed))[cand]
            good = 100 * total >= percent * (n + sizes[cand] - total)
            for y in cand[good].tolist():
                if label[y] != mine:
                    yield x, indexed[y]
                    if roles[x] == 0:
                        label[label == label[y]] = mine
                    else:  # a set outside the index joins the components it links with
                        label[label == (label[y] if mine > outside else mine)] = mine = label[y]
            found, times = found[~now], times[~now]
            width *= 2


def _scan(words: int):
    """Per document its set's size and signature; per task the list lengths it adds."""
    names = ["doc_id", "hash", "n", "s1", "s2", "chunk", "part"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, seen = np.zeros(ROWS * WIDTH, np.int32), set()
        for batch in batches:
            n, one, two = [], [], []
            for s in shingle_sets(batch["text"], words):
                a, b = signature(s)
                n.append(len(s)), one.append(a), two.append(b)
                if len(s) and (a, b) not in seen:
                    seen.add((a, b))
                    for at, sign in _sketched(s):
                        np.add.at(lengths, at, sign)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["hash"], pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        for k, part in split_chunks(lengths, CHUNKS):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *[pa.array([0], pa.int64())] * 4, pa.array([k], pa.int32()), pa.array([part], pa.binary())], names)

    return scan


def _short_lists(words: int, percent: int, lengths):
    """Postings of each set's short lists: its shingles of the least estimated list length."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = lengths.value, set()
        for batch in batches:
            out: list[tuple] = []
            for s in shingle_sets(batch["text"], words):
                sig = signature(s)
                if not len(s) or sig in seen:
                    continue
                seen.add(sig)
                n = len(s)
                length = estimated_lengths(known, s)
                first = np.argsort((length << np.uint64(32)) | (s >> np.uint64(32)), kind="stable")[: n - int(need(n, percent)) + spare(n, percent)]
                hot = length[first] >= HOT_LIST
                own = np.int64(mix(np.array([sig[0]], np.int64).view(np.uint64))[0] % np.uint64(64))
                out.append((s[first].view(np.int64), np.where(hot, own, -1), len(first), n, *sig))
            if out:
                times = [o[2] for o in out]
                yield pa.RecordBatch.from_pydict({
                    "list": np.concatenate([o[0] for o in out]), "deal": np.concatenate([o[1] for o in out]).astype(np.int32),
                    "n": np.repeat([o[3] for o in out], times), "s1": np.repeat([o[4] for o in out], times), "s2": np.repeat([o[5] for o in out], times),
                })

    return emit


def _read_lists(percent: int):
    """Rows sorted by list: pairs of the short lists, members of the long ones."""
    names = ["list", "n", "s1", "s2", "m", "t1", "t2"]

    def close(members: dict, out: list) -> None:
        members = list(members)
        if len(members) > 1:
            out += [(None, n, a, b, None, None, None) for n, a, b in members]
        for i, (n, a, b) in enumerate(members):
            for m, c, d in members[:i]:
                if 100 * min(n, m) >= percent * max(n, m):
                    x, y = sorted([(a, b, n), (c, d, m)])
                    out.append((None, x[2], x[0], x[1], y[2], y[0], y[1]))

    def pack(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, members, long = None, {}, False
        for batch in batches:
            out: list[tuple] = []
            for key, deal, n, a, b in zip(*(batch[c].to_pylist() for c in ("list", "deal", "n", "s1", "s2"))):
                if (key, deal) != last:
                    if not long:
                        close(members, out)
                    last, members, long = (key, deal), {}, deal >= 0
                if long:
                    out.append((key, n, a, b, None, None, None))
                    continue
                members[n, a, b] = None
                if len(members) > SHORT_LIST:
                    long = True
                    out += [(key, *x, None, None, None) for x in members]
            if out:
                yield pack(out)
        out = []
        if not long:
            close(members, out)
        if out:
            yield pack(out)

    return read


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits of the leading bits of a set's hashes, two to four times as many as shingles, packed. Sets differ in at least as many shingles as bits."""
    level = min(16, max(9, (2 * len(shingles) - 1).bit_length()))
    bits = np.zeros(1 << level, bool)
    bits[(shingles >> np.uint64(64 - level)).astype(np.int64)] = True
    return np.packbits(bits)


def _folded(bits: np.ndarray) -> np.ndarray:
    """The bitmap at half its size: the leading bits but one."""
    return np.packbits(np.unpackbits(bits).reshape(-1, 2).any(axis=1))


def plausible_clusters(sizes: np.ndarray, labels: np.ndarray, roles: np.ndarray, bits: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first of those that it is joined with by pairs that may link across labels: sizes fit and the bitmaps differ in no more bits than linked sets do in shingles.

    A set that is in no such pair stands for itself alone.
    """
    first = np.arange(len(sizes))
    level = np.array([len(b) for b in bits])
    for size in np.unique(level).tolist():  # linked sets are at most one level apart: their bitmaps are compared at the lower one
        own = np.flatnonzero((level == size) | (level == 2 * size))
        words = np.stack([bits[i] if level[i] == size else _folded(bits[i]) for i in own]).view(np.uint64)
        n, label, role, low = sizes[own], labels[own], roles[own], level[own] == size
        step = max(1, (1 << 20) // (len(own) * words.shape[1]))
        for i in range(0, len(own), step):
            part = slice(i, i + step)
            fit = (label[part, None] != label) & (low[part, None] | low) & np.where(role[part, None] == 0, role == 0, role[part, None] + role == 3)
            fit &= 100 * np.minimum(n[part, None], n) >= percent * np.maximum(n[part, None], n)
            if fit.any():
                apart = np.bitwise_count(words[part, None, :] ^ words[None, :, :]).sum(axis=2, dtype=np.int64)
                fit &= apart * (100 + percent) <= (100 - percent) * (n[part, None] + n)
                for k in np.flatnonzero(fit.any(axis=1)).tolist():
                    met = np.unique(np.append(first[own[fit[k]]], first[own[i + k]]))
                    if len(met) > 1:
                        first[np.isin(first, met)] = met[0]
    return first


def plausible(sizes: np.ndarray, labels: np.ndarray, roles: np.ndarray, bits: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets may link with one of another label."""
    first = plausible_clusters(sizes, labels, roles, bits, percent)
    return np.bincount(first, minlength=len(first))[first] > 1


def _plausible(percent: int):
    """Rows sorted by group: of each group the members that may link with one of another component, each with the first of its cluster."""
    names = ["g1", "g2", "lo", "hi", "s1", "s2", "role", "n", "t1", "t2"]

    def kept(group: tuple, members: list) -> Iterator[tuple]:
        members = list({m[:2]: m for m in members}.values())
        if len({m[3] for m in members}) > 1:
            _, _, roles, labels, sizes, bits = zip(*members)
            first = plausible_clusters(np.array(sizes), np.array(labels), np.array(roles), list(bits), percent)
            many = np.bincount(first, minlength=len(first))[first] > 1
            yield from ((*group, *m[:3], m[4], *members[f][:2]) for m, f, yes in zip(members, first.tolist(), many.tolist()) if yes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(out: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        last, members = None, []
        for batch in batches:
            out: list[tuple] = []
            groups = zip(*(batch[c].to_pylist() for c in names[:4]))
            for group, *own, bits in zip(groups, *(batch[c].to_pylist() for c in ("s1", "s2", "role", "label", "n")), batch["bits"]):
                if group != last:
                    out += kept(last, members)
                    last, members = group, []
                members.append((*own, np.frombuffer(bits.as_buffer(), np.uint8)))
            if out:
                yield pack(out)
        if out := list(kept(last, members)):
            yield pack(out)

    return read


def _sets(words: int, wanted):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = wanted.value, set()
        for batch in batches:
            out = []
            for s in shingle_sets(batch["text"], words):
                sig = signature(s)
                if len(s) and sig not in seen and known[(sig[0] & ((1 << 64) - 1)) >> 42]:
                    seen.add(sig)
                    out.append((*sig, s.tobytes(), bitmap(s).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["s1", "s2", "shingles", "bits"])

    return emit


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = np.zeros(WANTED, np.uint8)
    for batch in batches:
        marks[(batch["s1"].to_numpy().view(np.uint64) >> np.uint64(42)).astype(np.int64)] = 1
    for k, part in split_chunks(marks, 64):
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "part": pa.array([part], pa.binary())})


def _search(percent: int):
    """Rows sorted by group: each group's links."""

    def links_of(members: list) -> Iterator[tuple]:
        seen, kept = set(), []
        for m in members:
            if m[0] not in seen:
                seen.add(m[0])
                kept.append(m)
        sets = [m[2] for m in kept]
        for x, y in t_occurrence(sets, [m[1] for m in kept], percent):
            yield (*kept[x][0], *kept[y][0])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["s1", "s2", "t1", "t2"])

        last, members = None, []
        for batch in batches:
            out: list[tuple] = []
            groups = zip(*(batch[c].to_pylist() for c in ("g1", "g2", "lo", "hi")))
            for group, a, b, role, shingles in zip(groups, *(batch[c].to_pylist() for c in ("s1", "s2", "role")), batch["shingles"]):
                if group != last:
                    out += links_of(members)
                    last, members = group, []
                members.append(((a, b), role, np.frombuffer(shingles.as_buffer(), np.uint64)))
            if out:
                yield pack(out)
        if out := list(links_of(members)):
            yield pack(out)

    return search


def _tiles(held: DataFrame) -> DataFrame:
    """Groups of members (list, blocks, s1, s2): each pair of a list's blocks."""
    own = held.withColumn("block", F.pmod(F.xxhash64("s2", "s1"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    role = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("role")
    return own.select(F.col("list").alias("g1"), F.lit(0).cast("long").alias("g2"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "s1", "s2", role)


def _connected(spark: SparkSession, edges: DataFrame, classes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(class, component) of the classes at the ends of ``edges``, and of those that earlier edges connected (``known``)."""
    ends = edges.join(classes, ["s1", "s2"]).select(F.col("class").alias("a"), F.col("t1").alias("s1"), F.col("t2").alias("s2"))
    ends = ends.join(classes, ["s1", "s2"]).select("a", F.col("class").alias("b"))
    if known is not None:
        ends = ends.union(known.select("class", "component"))
    return write_through(spark, components(spark, ends).withColumnRenamed("node", "class"), "components")


def _met_once(spark: SparkSession, found: DataFrame, classes: DataFrame) -> DataFrame:
    """Groups in which all pairs of ``found`` meet that met there. Its sets share many lists: by clusters each is sent once, or to few tiles.

    Where a cluster is so large that its tiles would get more rows than its lists, the lists remain.
    """
    cluster = _connected(spark, found.select("s1", "s2", "t1", "t2"), classes).withColumnRenamed("component", "list")
    named = classes.select("s1", "s2", "class").join(cluster, "class").select("s1", "s2", "list")
    rows = found.drop("t1", "t2").join(named, ["s1", "s2"])
    members = rows.groupBy("list", "s1", "s2").agg(F.first("n").alias("n"), F.count("*").alias("sent"))
    members = write_through(spark, members, "clusters")
    blocks = F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK)).cast("int")
    whole = members.groupBy("list").agg(blocks.alias("blocks"), F.count("*").alias("size"), F.sum("sent").alias("sent")).where("blocks * size <= sent")
    whole = write_through(spark, whole.select("list", "blocks"), "whole")
    own = _tiles(salted_join(members.select("list", "s1", "s2"), whole, "list")).withColumn("g2", F.lit(1).cast("long"))
    return own.unionByName(salted_join(rows, whole.select("list"), "list", "left_anti").select(own.columns))


def _linked(spark: SparkSession, sets: DataFrame, stars: DataFrame, left: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(class, component) of all links among the members of ``stars`` (groups as they are) and ``left`` (long lists)."""

    def searched(groups: DataFrame) -> DataFrame:
        ready = groups.join(sets.drop("bits"), ["s1", "s2"]).repartition("g1", "g2", "lo", "hi").sortWithinPartitions("g1", "g2", "lo", "hi")
        with batches_of(spark, 500):
            return write_through(spark, ready.mapInArrow(_search(percent), "s1 long, s2 long, t1 long, t2 long"), "links")

    # Near copies share most of their lists. The longest of each set go first. Of the other lists only those count whose members
    # lie in different components by then, and in these only sets that may link across: small bitmaps, not whole sets, are sent to tell.
    longest = W.partitionBy("s1", "s2").orderBy(F.desc("size"), "list")
    chosen = write_through(spark, left.withColumn("rank", F.row_number().over(longest)).where(F.col("rank") <= EAGER).select("list").distinct(), "chosen")
    edges = searched(stars.unionByName(_tiles(salted_join(left, chosen, "list", "left_semi"))))
    linked = _connected(spark, edges, classes)
    named = classes.join(linked, "class", "left").select("s1", "s2", F.coalesce("component", "class").alias("label"))
    rest = salted_join(left, chosen, "list", "left_anti").join(named, ["s1", "s2"])
    apart = rest.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("list")
    rest = write_through(spark, salted_join(rest, apart, "list", "left_semi"), "rest")
    if rest.isEmpty():
        return linked
    told = _tiles(rest).join(sets.select("s1", "s2", "bits"), ["s1", "s2"]).join(rest.select("s1", "s2", "n", "label").distinct(), ["s1", "s2"])
    told = told.repartition("g1", "g2", "lo", "hi").sortWithinPartitions("g1", "g2", "lo", "hi")
    kinds = "g1 long, g2 long, lo int, hi int, s1 long, s2 long, role int, n long, t1 long, t2 long"
    with batches_of(spark, 2000):
        found = write_through(spark, told.mapInArrow(_plausible(percent), kinds), "groups")
    return _connected(spark, searched(_met_once(spark, found, classes)), classes, linked)


def _classes(spark: SparkSession, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, hash, n, set), ``set`` null without id or words, and (set, component_id) of sets that more than one row has or that link."""
    sc = spark.sparkContext
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashed = source.withColumn("hash", F.coalesce(F.xxhash64("text"), F.lit(0)))
    with batches_of(spark, 2000):
        scanned = write_through(spark, hashed.mapInArrow(_scan(words), "doc_id long, hash long, n long, s1 long, s2 long, chunk int, part binary"), "sets")
    lengths = sc.broadcast(fold_chunks(spark, scanned.where("chunk IS NOT NULL"), CHUNKS, "int32", ROWS * WIDTH, np.add))
    rows = scanned.where("chunk IS NULL").select("doc_id", "hash", "n", "s1", "s2")

    postings = source.where("doc_id IS NOT NULL").select("text").mapInArrow(_short_lists(words, percent, lengths), "list long, deal int, n long, s1 long, s2 long")
    postings = postings.repartition("list", "deal").sortWithinPartitions("list", "deal")
    with batches_of(spark, 2000):
        found = write_through(spark, postings.mapInArrow(_read_lists(percent), "list long, n long, s1 long, s2 long, m long, t1 long, t2 long"), "lists")
    lengths.destroy()

    asked = lambda n: f"(1 + ({n} - {need_sql(n)}) DIV 2)"
    need_sql = lambda n: f"CAST(ceil({percent} * {n} / 100) AS bigint)"
    # A set with a partner of at least percent/100 of its size is on so many lists with others.
    busy = found.where("m IS NULL").groupBy("s1", "s2", "n").agg(F.count("*").alias("shared")).where(f"shared >= {asked(need_sql('n'))}").select("s1", "s2")
    busy = write_through(spark, busy, "busy")
    pairs = found.where("m IS NOT NULL").groupBy("s1", "s2", "t1", "t2", "n", "m").agg(F.count("*").alias("times"))
    pairs = pairs.where(f"times >= least({asked('n')}, {asked('m')})")
    zero = F.lit(0)
    stars = pairs.select(F.col("s1").alias("g1"), F.col("s2").alias("g2"), F.lit(-1).alias("lo"), zero.alias("hi"), F.array(
        F.struct("s1", "s2", F.lit(2).alias("role")), F.struct(F.col("t1").alias("s1"), F.col("t2").alias("s2"), F.lit(1).alias("role"))).alias("two"))
    stars = stars.select("g1", "g2", "lo", "hi", F.inline("two")).distinct()

    members = found.where("list IS NOT NULL").join(busy, ["s1", "s2"], "left_semi").select("list", "n", "s1", "s2").distinct()
    lists = members.groupBy("list").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.sum(F.xxhash64("s1", "s2").cast("decimal(20,0)")).alias("who")).where("size > 1")
    lists = lists.groupBy("size", "weight", "who").agg(F.min("list").alias("list"))  # lists of the same members are searched once
    lists = lists.select("list", "size", F.greatest(F.lit(1), F.ceil(F.col("weight") / BLOCK)).cast("int").alias("blocks"))
    left = write_through(spark, salted_join(members, lists, "list"), "members")

    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("class"), F.count("*").alias("copies"))
    classes = write_through(spark, classes, "classes")
    asked_for = stars.select("s1").union(left.select("s1"))
    wanted = sc.broadcast(fold_chunks(spark, asked_for.mapInArrow(_mark, "chunk int, part binary"), 64, "uint8", WANTED, np.bitwise_or))
    raw = source.where("doc_id IS NOT NULL").select("text").mapInArrow(_sets(words, wanted), "s1 long, s2 long, shingles binary, bits binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = raw.repartition(buckets, "s1", "s2").groupBy("s1", "s2").agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits"))
    with batches_of(spark, 2000), write_bucketed(spark, sets, "shingles", ["s1", "s2"], buckets) as sets:
        wanted.destroy()  # the sets are written by now
        linked = _linked(spark, sets, stars, left, classes, percent)

    classes = classes.join(linked, "class", "left").where("copies > 1 OR component IS NOT NULL")
    classes = classes.select(F.struct("s1", "s2").alias("set"), F.coalesce("component", "class").alias("component_id"))
    own = rows.select("doc_id", "hash", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.struct("s1", "s2")).alias("set"))
    return own, classes


def ngram_join(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked by shingle sets of Jaccard ``percent``/100 or more.

    Equal sets are one class from the start. Each set posts its short lists, the rarest shingles by a
    sketch of list lengths over the whole corpus, at least ``T - L`` of which a partner shares. A pair from
    lists of up to SHORT_LIST members is searched if it shares that many of them; members of longer lists meet in
    tiles of bounded size, each searched with DivideSkip, a set's longest list first; of the others only members whose bitmaps allow a
    link with another component are sent. Links found connect; the links left
    out join documents that others connect already. No list, bucket or partner count is capped.

    Null text counts as empty; empty sets link with nothing. A row without an id links with nothing and has
    a null component. Repeated rows stay; all other columns are left out.
    """
    own, classes = _classes(spark, docs, words, percent, id_col, text_col)
    full = salted_join(own, classes, "set", "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``ngram_join``: of those of its smallest id one of the least text hash. Columns as given.

    Rows are known by id and text hash, so that a row whose id another, linked row repeats stays, and of rows with
    equal id and text one stays. Rows without an id or without words link with nothing and stay as they are.
    """
    own, classes = _classes(spark, docs, words, percent, id_col, text_col)
    members = salted_join(own.select("doc_id", "hash", "set"), classes, "set").groupBy("component_id", "doc_id", "hash").agg(F.count("*").alias("rows"))
    members = write_through(spark, members, "members")
    least = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "hash")).alias("least"))
    fate = salted_join(members, least, "component_id").select(F.struct("doc_id", "hash").alias("key"), (F.struct("doc_id", "hash") == F.col("least")).alias("stays"), "rows")
    fate = fate.where("NOT stays OR rows > 1").select("key", "stays")
    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("hash"))
    met = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")).join(fate, "key", "left")
    met = write_through(spark, met.where("stays IS NULL OR stays"), "kept")
    once = met.where("stays").groupBy("key").agg(F.first("row").alias("row"))
    return met.where("stays IS NULL").select("row.*").unionByName(once.select("row.*")).select(docs.columns)
