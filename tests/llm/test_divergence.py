import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from codescope.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(rows, least=10, top=10):
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        own = terms(text)
        groups[lang or "", source or ""].update(own)
        held[lang or ""].update(set(own))
    out = []
    for lang, docs in held.items():
        kept = [t for t, n in docs.items() if n >= least]
        own = {s: c for (x, s), c in groups.items() if x == lang}
        whole = sum(own.values(), Counter())

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        share, q = {s: p(c) for s, c in own.items()}, p(whole)
        for s, c in own.items():
            pair = sorted((-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in own if o != s)
            best = sorted((-f(share[s][t], q[t]), t.encode()) for t in kept if c[t] > 0 and share[s][t] > q[t])[:top]
            for part, found in (("pair", pair), ("term", best)):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


def documents(seed=0):
    rng = random.Random(seed)
    words = ["a", "The", "the", "ÜBER", "über", "eightchr", "ninechars", "sixteencharacter", "seventeencharact", "x" * 17, "Y" * 40, "語" * 30, "😀", "é", "é", "ab1cd", "z" * 130]
    words += ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 20))) for _ in range(60)]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "é", None]), " ".join(rng.choices(words, k=rng.randrange(0, 60))) + rng.choice(["", "-", "1\x00", "end"])) for _ in range(240)]
    rows += [("fr", "s1", "seul"), ("fr", "s3", None), ("it", "x", ""), ("en", "empty", "12 34"), ("en", "s1", "w" * 200_000 + " the"), ("en", "s2", "the " * 5000)]
    return rows + rows[:3]


def test_equals_brute_force(spark, monkeypatch):
    rows = documents()
    docs = spark.createDataFrame([(k, *r, "clash", 1) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int")
    want = brute(rows)
    assert {r[2] for r in want} == {"pair", "term"}
    for chunk, cells in ((divergence.CHUNK, divergence.CELLS), (500, 40)):
        monkeypatch.setattr(divergence, "CHUNK", chunk)
        monkeypatch.setattr(divergence, "CELLS", cells)
        got = divergence.audit_sources(spark, docs)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == want
    assert divergence.audit_sources(spark, docs.limit(0)).collect() == []


def test_counts_of_every_bucket():
    texts = ["Ab aB abc", "abcdefgh abcdefghi " + "q" * 16 + " " + "q" * 17, "", "ab" + "é" * 50, "é" * 50 + "|" + "é" * 50]
    got = Counter()
    docs = Counter()
    for group, term, n, held in divergence.count_terms([pa.array(texts[:2]), pa.array(texts[2:])], np.array([0, 0, 0, 1, 1])):
        for g, t, a, b in zip(group.tolist(), term.to_pylist(), n.tolist(), held.tolist()):
            got[g, t.decode()] += a
            docs[g, t.decode()] += b
    want, within = Counter(), Counter()
    for k, text in enumerate(texts):
        want.update((int(k > 2), t) for t in terms(text))
        within.update({(int(k > 2), t) for t in terms(text)})
    assert got == want and docs == within


def test_shares_are_exact():
    for count, total in ((5, 7), (10**15, 8 * 10**15), (2, 9 * 10**15), (7, 7), (0, 3)):
        assert divergence.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total
