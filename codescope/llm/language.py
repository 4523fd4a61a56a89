"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams."""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm.common import batches_of, fold_chunks, split_chunks

#: Hashed features for character 1-, 2- and 3-grams together.
FEATURES = 1 << 17
ORDERS = (1, 2, 3)
CHUNKS = 64
#: The fit reads at most so many labelled documents of each language; everything else reads all documents.
PER_LANGUAGE = 1500
#: Follow the regularised leader: step, smoothing, L1 and L2; passes over the sample; scale of a term frequency.
ALPHA, BETA, L1, L2, PASSES, SCALE = 0.5, 1.0, 0.05, 0.01, 3, 50.0
UNKNOWN = "und"
_STRETCH = 1 << 18


def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else a blank; made once a worker."""
    state = sys.modules.setdefault("_codescope_worker", types.ModuleType("_codescope_worker")).__dict__
    if "letters" not in state:
        state["letters"] = np.array([k if chr(k).isalpha() else 32 for k in range(sys.maxunicode + 1)], np.uint32)
    return state["letters"]


def grams(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(first text, bounds, features of each order by place, has a letter) for stretches of texts.

    Texts are lower-cased; all but letters count as blanks; a blank stands before and two after each text.
    """
    table, k = _letters(), 0
    while k < len(texts):
        parts, size, first = [], 0, k
        while k < len(texts) and (size < _STRETCH or not parts):
            code = np.frombuffer((texts[k] or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            code = table[code]
            parts.append(np.concatenate([[32], code, [32, 32]]).astype(np.uint32))
            size += len(code)
            k += 1
        c = np.concatenate(parts).astype(np.uint64)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        h, found = np.zeros(len(c), np.uint64), []
        for order in ORDERS:
            h[: len(c) - order + 1] = h[: len(c) - order + 1] * np.uint64(0x9E3779B97F4A7C15) + c[order - 1 :] + np.uint64(order)
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((x >> np.uint64(64 - 17)).astype(np.int64))
        known = np.array([bool((p != 32).any()) for p in parts])
        yield first, bounds, found, known


def _each(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(text, all its features) for texts with a letter; a text's grams begin at all places but its last two."""
    for first, bounds, found, known in grams(texts):
        for k in np.flatnonzero(known):
            a, b = bounds[k], bounds[k + 1] - 2
            yield first + int(k), np.concatenate([f[a:b] for f in found])


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, mark = np.zeros(FEATURES + CHUNKS, np.int64), np.zeros(FEATURES, bool)
    for batch in batches:
        for _, features in _each(batch["text"].to_pylist()):
            mark[features] = True
            total[:FEATURES] += mark
            total[FEATURES] += 1  # the documents
            mark[:] = False
    for k, part in split_chunks(total, CHUNKS):
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "part": pa.array([part], pa.binary())})


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int, passes: int = PASSES) -> np.ndarray:
    """Weights (feature, language) by follow the regularised leader; most stay exactly 0 under the L1 penalty."""
    z, n, w = (np.zeros((FEATURES, languages)) for _ in range(3))
    for _ in range(passes):
        for at, x, y in rows:
            own = z[at]
            weight = np.where(np.abs(own) > L1, (np.sign(own) * L1 - own) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)
            p = softmax(x @ weight)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            square = n[at]
            z[at] = own + g - (np.sqrt(square + g * g) - np.sqrt(square)) / ALPHA * weight
            n[at] = square + g * g
    return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), w)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> dict:
    """A model from the labelled documents that are not held out.

    Document frequencies cover all of them. The weights come from at most ``per_language`` of each
    language, those of the smallest hashes of their ids; every fifth of these only sets the temperature.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang"), held_out(id_col).alias("out"))
    known = known.where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND NOT out").select("id", "text", "lang")
    with batches_of(spark, 2000):
        sums = fold_chunks(spark, known.select("text").mapInArrow(_document_frequency, "chunk int, part binary"), CHUNKS, "int64", FEATURES + CHUNKS, np.add)
    idf = np.log((1 + sums[FEATURES]) / (1 + sums[:FEATURES])) + 1.0

    sizes = known.groupBy("lang").agg(F.count("*").alias("size"))
    unit = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.join(sizes, "lang").withColumn("unit", unit).where(F.col("unit") * F.col("size") < 1.2 * per_language + 20)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: dict[str, int] = {}
        rows, spare = [], []
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for k, features in _each(batch["text"].to_pylist()):
                turn = taken[langs[k]] = taken.get(langs[k], 0) + 1
                if turn <= per_language:
                    at, count = np.unique(features, return_counts=True)
                    (spare if turn % 5 == 0 else rows).append((at, SCALE * idf[at] * count / len(features), langs[k]))
        names = sorted(taken)
        if not names:
            return
        number = {name: k for k, name in enumerate(names)}
        weights = fit_ftrl([(a, x, number[y]) for a, x, y in rows], len(names))
        logits = np.array([x @ weights[a] for a, x, _ in spare]).reshape(-1, len(names))
        t = fit_temperature(logits, np.array([number[y] for *_, y in spare], int))
        used = np.flatnonzero(weights.any(axis=1))
        yield pa.RecordBatch.from_pydict({"langs": pa.array([names], pa.list_(pa.string())), "temperature": [t], "used": pa.array([zlib.compress(used.astype("<i4").tobytes())], pa.binary()), "weights": pa.array([zlib.compress(weights[used].astype("<f4").tobytes())], pa.binary())})

    with batches_of(spark, 500):
        found = drawn.select("text", "lang", "unit", "id").repartition(1).sortWithinPartitions("unit", "id").select("text", "lang").mapInArrow(train, "langs array<string>, temperature double, used binary, weights binary").collect()
    if not found:
        return {"languages": [], "values": np.zeros((FEATURES, 0), np.float32), "temperature": 1.0}
    row = found[0]
    values = np.zeros((FEATURES, len(row["langs"])), np.float32)
    used = np.frombuffer(zlib.decompress(row["used"]), "<i4")
    values[used] = np.frombuffer(zlib.decompress(row["weights"]), "<f4").reshape(len(used), -1) * idf[used, None] * SCALE
    return {"languages": list(row["langs"]), "values": values, "temperature": row["temperature"]}


def predict(spark: SparkSession, docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced): the whole text decides.

    The score is the calibrated probability of the predicted language. Without a letter, or without anything learned, the
    language is ``und`` and the score 0. Equal texts have equal predictions; ties go to the first name.
    """
    sent = spark.sparkContext.broadcast(model)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, values, temperature = (sent.value[k] for k in ("languages", "values", "temperature"))
        for batch in batches:
            texts = batch[names.index(text_col)].to_pylist()
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for first, bounds, found, known in grams(texts) if languages else ():
                by_place = sum(values[f] for f in found).astype(np.float64)
                for k in np.flatnonzero(known):
                    a, b = bounds[k], bounds[k + 1] - 2
                    p = softmax(by_place[a:b].sum(axis=0) / (len(ORDERS) * (b - a)) / temperature)
                    pred[first + k], score[first + k] = languages[int(p.argmax())], min(1.0, float(p.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    own = docs.select(*(F.col(c) for c in docs.columns if c not in ("lang_pred", "score")))
    names = own.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(tell, f"{schema}, lang_pred string, score double")


def identify(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; rows without id, text or label are predicted, never learned from."""
    model = fit(spark, docs, per_language, id_col, text_col, label_col)
    own = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(spark, own, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(spark: SparkSession, docs: DataFrame, least: float = 0.5, **columns: str) -> DataFrame:
    """``docs`` whose language is known with a score of at least ``least``; columns as given."""
    model = fit(spark, docs, **columns)
    return predict(spark, docs.withColumnsRenamed({c: f"_own_{c}" for c in ("lang_pred", "score")}), model, columns.get("text_col", "text")).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).drop("lang_pred", "score").withColumnsRenamed({f"_own_{c}": c for c in ("lang_pred", "score")})
