import random
import re
from collections import defaultdict

from codescope.llm import lines

SPACE = r"[\x20\x09-\x0D]+"
LAST = 1 << 63


def templates(line):
    """(tokens, whole, general) of a line."""
    t = [w for w in re.split(SPACE, line) if w]
    m = ["<*>" if re.search("[0-9]", w) else w for w in t]
    n, general = len(t), []
    third = -(-(n - 4) // 3)
    constant = n - (m.count("<*>") if m != t else 0)
    if m != t and constant >= 8 and 3 * constant >= 2 * n:
        general.append((n, "fields", *m))
    if n >= 12 and constant - third >= 8 and 3 * (constant - third) >= 2 * n:
        parts = [m[4 + third * k : 4 + third * (k + 1)] for k in range(3)]
        general += [(n, k, *m[:4], *("|".join(p) for j, p in enumerate(parts) if j != k)) for k in range(3)]
    return n, (n, *t), general


def brute(rows):
    times, docs = defaultdict(int), defaultdict(set)
    parsed = []
    for d, text in rows:
        own = [(i, *templates(x)) for i, x in enumerate((text or "").split("\n"))]
        own = [x for x in own if x[1]]
        parsed.append(own)
        for k in {("whole", x[2]) for x in own} | {g for x in own for g in x[3]}:
            times[k] += 1
            docs[k].add(LAST if d is None else d)
    bad = {k: min(docs[k]) for k in times if len(docs[k]) > 1 and times[k] >= (2 if k[0] == "whole" else 3)}
    out = []
    for (d, text), own in zip(rows, parsed):
        if text is None:
            out.append((d, None, 0))
            continue
        me = LAST if d is None else d
        hit = [any(bad.get(k, me) != me for k in [("whole", x[2]), *x[3]]) for x in own]
        gone, k = set(), 0
        while k < len(own):
            to = k
            while to < len(own) and hit[to]:
                to += 1
            total = sum(x[1] for x in own[k:to])
            gone |= {x[0] for x in own[k:to] if x[1] >= 5 or total >= 20}
            k = max(to, k + 1)
        own_lines = text.split("\n")
        out.append((d, "\n".join(x for i, x in enumerate(own_lines) if i not in gone), len(gone)))
    return sorted(map(str, out))


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "p", 1, "g", "k", "r") for d, t in rows], "doc_id long, text string, pos string, lines_dropped int, _gone string, _key string, row string")
    got = lines.drop_recurring_lines(spark, docs)
    assert got.columns == ["doc_id", "text", "pos", "_gone", "_key", "row", "lines_dropped"]
    found = got.collect()
    assert sorted(str((r.doc_id, r.text, r.lines_dropped)) for r in found) == brute(rows)
    assert {(r["pos"], r["_gone"], r["_key"], r["row"]) for r in found} <= {("p", "g", "k", "r")}
    return {r.doc_id: r for r in found}


def test_drops_recurring_lines_but_their_first(spark):
    passage = " ".join(f"tok{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55))
    broken = "\n".join(" ".join(passage.split(" ")[i : i + 3]) for i in range(0, 55, 3))
    footer = "Printed on {} by the press of the old town and its many friends"
    rows = [(3, f"clean line one of three\n{passage}\nYes"), (1, f"other words here\n{passage}\n" + footer.format("2020-01-02")), (2, footer.format("1999") + "\nNo"), (20, footer.format("12.3.") + "\nthe end of it"),
            (4, ""), (5, None), (6, "Yes\nYes\nYes"), (7, "\n \n\t"), (8, "rights reserved by us all\r\nkeep me"), (9, " rights  reserved by us all"), (10, "rights reserved by us all"), (11, "rights reserved by us all"),
            (None, "rights reserved by us all\nnull id"), (None, passage), (2, "same id again"), (12, "x" * 20_000 + "1"), (13, "No\nNo"), (14, f"start\n{broken}\nend of fourteen"), (15, f"{broken}\n\nYes")]
    by = check(spark, rows)
    assert by[3].text == "clean line one of three\nYes" and passage in by[1].text
    assert "1999" not in by[2].text and by[20].text == "the end of it" and "2020" in by[1].text
    assert by[9].text == "" and by[8].text.endswith("keep me") and "rights" in by[8].text
    assert by[6].text == "Yes\nYes\nYes" and by[13].text == "No\nNo"
    assert broken in by[14].text and by[15].text == "" and by[15].lines_dropped == 20  # the run takes short lines along
    assert lines.drop_recurring_lines(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_unique_text_stays(spark):
    rng = random.Random(1)
    table = lambda: "\n".join(" ".join(str(rng.randrange(10**6)) for _ in range(10)) for _ in range(30))
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    half = "the minutes of the meeting say that " + "{} " * 8
    rows = [(k, table()) for k in range(8)] + [(100 + k, half.format(*rng.sample(words, 8))) for k in range(8)] + [(200 + k, f"Page {k} of 20\nChapter {k}") for k in range(8)]
    assert all(r.lines_dropped == 0 for r in check(spark, rows).values())


def test_random_lines_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "b", "c", "d1", "2", "e"]
    base = [" ".join(rng.choices(words, weights=[5, 5, 5, 1, 1, 5], k=rng.choice([1, 3, 5, 9, 14, 20]))) for _ in range(30)]

    def line():
        t = rng.choice(base).split(" ")
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = rng.choice(["x", "7", "yy"])
        return rng.choice(["", " "]) + "  ".join(t) if rng.random() < 0.9 else ""

    check(spark, [(rng.choice([None, *range(30)]), "\n".join(line() for _ in range(rng.randrange(0, 8)))) for _ in range(80)])
