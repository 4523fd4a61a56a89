import ast
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from tests.llm import test_lines, test_ngram_join

DOCS = Path("/root/testdata/sf0.001/documents.parquet")
pytestmark = pytest.mark.skipif(not DOCS.exists(), reason="given tables not at hand")
PASSAGE = " ".join(f"passage word {chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40))


def with_edges(docs):
    """Given documents with nulls, no letters, copies, near copies, a shared passage and a row without id."""
    some = docs.where("text IS NOT NULL").orderBy("doc_id").limit(2).collect()
    near = some[1]["text"].split(" ")
    near[len(near) // 2] = "Changed"
    more = [(900_001, None), (900_002, ""), (900_003, "12 34"), (900_004, some[0]["text"]), (900_005, " ".join(near)), (900_006, f"{some[0]['text'][:400]}\n{PASSAGE}"), (900_007, f"{some[1]['text'][:400]}\n{PASSAGE}"), (None, some[0]["text"][:300])]
    rows = docs.sparkSession.createDataFrame([(d, t, some[0]["lang"], some[0]["source"], len(t or "")) for d, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.unionByName(rows)


def test_stages_on_what_they_are_given(spark):
    docs = with_edges(spark.read.parquet(str(DOCS)))
    given, kept = [], docs
    for name, stage in pipeline.STAGES:
        given.append(sorted(((r["doc_id"], r["text"], r["source"]) for r in kept.collect()), key=str))
        out = pipeline.write_through(spark, stage(spark, kept, str(DOCS.parent)), name)
        assert name == "best_fit_packing" or out.columns == docs.columns
        kept = out
    whole, known, lined, single, mixed = given

    # Language: what has no letter goes, nearly all of the rest stays, as it was.
    assert not {900_001, 900_002, 900_003} & {d for d, *_ in known} and not Counter(known) - Counter(whole)
    assert len(known) > 0.95 * (len(whole) - 3)

    # Lines: as brute force over all that was kept has it; the passage stays with one document.
    texts = {d: t for d, t, _ in lined}
    assert sum(PASSAGE in t for t in texts.values()) == 1
    wanted = map(ast.literal_eval, test_lines.brute([(d, t) for d, t, _ in known]))
    assert Counter((d, t) for d, t, _ in lined) == Counter((d, t) for d, t, gone in wanted if not gone or t.strip(" \t\n\v\f\r"))

    # Near duplicates: the smallest id of each component, and rows without an id.
    named = [(d, t) for d, t, _ in lined if d is not None]
    found = test_ngram_join.brute([d for d, _ in named], [t for _, t in named], 5, 80)
    assert {d for d, *_ in single} == {d for d, _, smallest in found if smallest == d} | {d for d, *_ in lined if d is None}

    # Mixing: every document, none more than about twice a pass over its source.
    assert set(mixed) == set(single)
    assert max(Counter(mixed).values()) <= 3

    # Packing: all tokens of every row, once, without gaps.
    rows = kept.collect()
    sizes = defaultdict(list)
    for r in rows:
        sizes[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sizes.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(d for d, *_ in mixed)
    assert len(sizes) <= 1 + sum(r["length"] for r in rows) / 2048 * 1.1


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(str(DOCS)).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_one_row_of_each_component_stays(spark):
    a, b, c = ("one two three four five six seven eight nine ten", "other words of a clean text that nothing else repeats", "a third text with words enough to stand alone here")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, a), (None, a), (4, ""), (4, ""), (5, None), (6, c), (7, b[:20]), (7, c[:25])]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, key string, row int")
    got = pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, a), (2, b), (3, c), (None, a), (None, a), (4, ""), (4, ""), (5, None), (7, b[:20]), (7, c[:25])]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
