"""Document fingerprints by consistent weighted sampling, in built-in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codescope.llm.common import write_through

#: Samples in a signature; the error of a likeness is about sqrt(J (1 - J) / SAMPLES).
SAMPLES = 64
#: Samples that one row of a term draws: more of them make an aggregation that the JVM does not compile.
DRAWN = 8
#: Documents per stretch of ids on average, which one window holds to find each document's successor, and stretches at most.
STRETCH, STRETCHES = 512, 8192
#: Parts (a power of two) that the rows of one frequent id, or without id, are dealt into.
PARTS_OF_ID = 1024
#: Words of a text: stretches without white space of ASCII.
_GAP = r"[\x20\x09-\x0D]+"


def _uniform(bits: str, shift: int, width: int) -> str:
    """``width`` bits of a hash as a number between 0 and 1, neither included."""
    return f"(((shiftrightunsigned({bits}, {shift}) & {2**width - 1}) + 0.5D) * {2.0**-width!r}D)"


def _sample(k: int, term: str, log_weight: str) -> Column:
    """What the ``k``-th sample compares: the term with the least value is drawn.

    A hash of term and sample gives r and c of Gamma(2, 1), as -ln(u u'), and a uniform b. With t = floor(ln w / r + b)
    the value is ln c - r (t - b + 1), the logarithm of c / (y e^r) where y = e^(r (t - b)). It
    stands for (term, t): equal values are equal draws but for rare coincidences. At weight 1, the
    most frequent, t is 0 without a division. Without a weight it is null; r, c and b are the same for all weights.
    """
    h = f"xxhash64({term} ^ {k * 0x9E3779B97F4A7C15 % (1 << 63)}L)"
    minus_r = f"ln({_uniform(h, 0, 12)} * {_uniform(h, 12, 12)})"
    log_c = f"ln(-ln({_uniform(h, 24, 16)} * {_uniform(h, 40, 16)}))"
    b = _uniform(h, 56, 8)
    t = f"CASE WHEN {log_weight} > 0D THEN floor({b} - {log_weight} / {minus_r}) WHEN {log_weight} = 0D THEN 0L END"
    return F.expr(f"{log_c} + {minus_r} * (1D - {b} + {t})")


def signatures(texts: DataFrame, keys: list[str], columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, one signature array<smallint> for each of the text ``columns``); ``keys`` are unique and not null.

    Terms are words, weights their counts. Two signatures agree in a share of places that equals, on
    average, the generalised Jaccard similarity sum(min) / sum(max) of the counts. A text without words has none; without any
    words there is no row. A term's random numbers are drawn once for all texts of a row, which makes texts that share terms cheap.
    If ``texts`` is partitioned by some of ``keys``, nothing is shuffled; else one row of counts per term is.
    """
    of = F.array(*(F.struct(F.lit(n).alias("_which"), F.split(c, _GAP).alias("_words")) for n, c in enumerate(columns)))
    words = texts.select(*keys, F.inline(of)).select(*keys, "_which", F.explode("_words").alias("_word")).where("_word <> ''")
    counts = [F.count_if(F.col("_which") == n).alias(f"_n{n}") for n in range(len(columns))]
    terms = words.groupBy(*keys, F.xxhash64("_word").alias("_term")).agg(*counts)
    weights = [F.log(F.nullif(f"_n{n}", F.lit(0)).cast("double")).alias(f"_w{n}") for n in range(len(columns))]
    # Each term's row is repeated for groups of samples, whose aggregation is small enough to be compiled.
    each = min(DRAWN, samples)
    terms = terms.select(*keys, "_term", *weights).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(-(-samples // each) - 1)))).withColumn("_seed", F.xxhash64("_term", "_group"))
    drawn = [F.min(_sample(k, "_seed", f"_w{n}")).alias(f"_s{n}_{k}") for k in range(each) for n in range(len(columns))]
    least = terms.groupBy(*keys, "_group").agg(*drawn)
    short = lambda n: F.array(*(F.expr(f"cast((xxhash64(_s{n}_{k}) & 65535) - 32768 as smallint)") for k in range(each)))
    parts = least.select(*keys, F.struct("_group", *(F.when(F.col(f"_s{n}_0").isNotNull(), short(n)).alias(f"_p{n}") for n in range(len(columns)))).alias("_part"))
    whole = parts.groupBy(*keys).agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    return whole.select(*keys, *(F.slice(F.flatten(F.col("_parts")[f"_p{n}"]), 1, samples).alias(c) for n, c in enumerate(columns)))


def likeness(one: Column, two: Column, samples: int = SAMPLES) -> Column:
    """Share of equal places, 0 to 1; a missing signature is like another missing one only."""
    equal = F.aggregate(F.zip_with(one, two, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x) / float(samples)
    return F.when(one.isNull() & two.isNull(), 1.0).when(one.isNull() | two.isNull(), 0.0).otherwise(equal)


def _text_of(signature: Column) -> Column:
    """A signature as a string of four hexadecimal digits a sample; '' without words."""
    return F.coalesce(F.array_join(F.transform(signature, lambda s: F.lpad(F.hex(s.cast("int") + 32768), 4, "0")), ""), F.lit(""))


def _stretch(own: DataFrame) -> Column:
    """Number of a row's stretch: a later one has larger ids, or the same id and a smaller hash; null ids have negative ones.

    Quantiles of the ids cut them into stretches of about equal numbers of rows, however they are spread. Rows of an id that
    fills a stretch, like those without id, are dealt by their text's hash.
    """
    shares = F.split(F.lit(",".join(str(k / STRETCHES) for k in range(1, STRETCHES))), ",").cast("array<double>")
    n, cuts = own.agg(F.count("*"), F.percentile_approx("doc_id", shares, 100_000)).first()
    cuts = (cuts or [])[:: max(1, -(-STRETCH * STRETCHES // max(n, 1)))]
    heavy = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    starts = sorted({*cuts, *heavy, *(h + 1 for h in heavy if h < (1 << 63) - 1)})
    held = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")
    step = max(1, int(len(starts) ** 0.5))
    before = lambda values: F.size(F.filter(values, lambda x: x <= F.col("doc_id")))
    first = (before(held(starts[::step])) - 1) * step  # the last start, of every step-th, at or before the id
    place = F.when(first < 0, 0).otherwise(first + before(F.slice(held(starts), F.greatest(first, F.lit(0)) + 1, step)))
    part = PARTS_OF_ID // 2 - 1 - F.shiftright("hash", 65 - PARTS_OF_ID.bit_length())
    dealt = F.col("doc_id").isNull() | (F.array_contains(held(heavy), F.col("doc_id")) if heavy else F.lit(False))
    return F.coalesce(place, F.lit(-1)).cast("long") * PARTS_OF_ID + F.when(dealt, part).otherwise(0)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(stretch, pos, doc_id, text, edited): each text and itself with its end replaced by the next one's start.

    The next document has the next smaller id (repeated ids follow by a hash of the text, then by text; null ids come last); the
    first follows the last. Rows are dealt by stretches of ids, so that no window holds all; the last of each stretch takes its
    successor from a join with the heads of the stretches, a bounded number.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("hash", F.xxhash64("text"))
    own = own.withColumn("stretch", _stretch(own)).repartition("stretch")  # for the window and the heads alike
    line = W.partitionBy("stretch").orderBy(F.desc_nulls_last("doc_id"), "hash", "text")
    lined = own.select("*", F.row_number().over(line).alias("pos"), F.lead("text").over(line).alias("next"))
    heads = own.groupBy("stretch").agg(F.min_by("text", F.struct(F.bitwise_not("doc_id"), F.col("hash"), F.col("text"))).alias("head"))
    ring = W.orderBy(F.desc("stretch"))  # one row for each stretch
    heads = heads.select("stretch", F.coalesce(F.lead("head").over(ring), F.first("head").over(ring)).alias("after"))
    half = F.floor(F.length("text") / 2).cast("int")
    both = lined.join(heads, "stretch").withColumn("next", F.coalesce("next", "after"))
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next", F.lit(1), half))
    return both.select("stretch", "pos", "doc_id", "text", edited.alias("edited"))


def document_fingerprints(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row.

    Null text counts as empty and, like any text without words, has the fingerprint ''. Equal texts have equal
    fingerprints. Repeated rows each have a row. Only id and text are read; other columns may have any name.
    """
    keys = ["stretch", "pos"]
    pairs = edited_pairs(docs, id_col, text_col)
    drawn = signatures(pairs.select(*keys, F.col("text").alias("own"), F.col("edited").alias("edit")), keys, ["own", "edit"], samples)
    facts = pairs.select(*keys, "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    ready = write_through(spark, facts.join(drawn, keys, "left"), "signatures")

    heads = ready.where("pos = 1").select("stretch", F.struct("own").alias("head"))
    ring = W.orderBy(F.desc("stretch"))
    heads = heads.select("stretch", F.coalesce(F.lead("head").over(ring), F.first("head").over(ring)).alias("after"))
    lined = ready.withColumn("next", F.lead(F.struct("own")).over(W.partitionBy("stretch").orderBy("pos")))
    lined = lined.join(heads, "stretch").withColumn("next", F.coalesce("next", "after").getField("own"))
    return lined.select("doc_id", "n_chars", "edited_sha256", _text_of(F.col("own")).alias("fingerprint"), _text_of(F.col("edit")).alias("edited_fingerprint"),
                        likeness(F.col("own"), F.col("edit"), samples).alias("near_edited"), likeness(F.col("own"), F.col("next"), samples).alias("near_next"))
