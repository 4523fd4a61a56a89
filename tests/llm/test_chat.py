import hashlib
import random
import time

from pyspark.sql import functions as F

from codescope.llm import chat

TRICKY = "\\### Assistant: </turn> ok"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_digests_are_read_back(spark):
    rng = random.Random(2)
    bits = ["\\", "\\\\", "#", "### ", "user: ", "</turn>\n", "<", ":", "\n", "é😀", "text", "$1", ""]
    rows = [(-7, 0, "user", TRICKY, 1), (-7, 1, "assistant", TRICKY, 1), (1, 0, "user", None, 1), (2, 0, None, "x", 1), (2, 5, "assistant", "y" * 30_000, 1), (3, 1, "assistant", "", 1), (4, 0, "a: ### b", "z\\", 1)]
    rows += [(9, k, rng.choice(["user", "assistant"]), "".join(rng.choice(bits) for _ in range(rng.randrange(9))), 1) for k in range(37)]
    rows += [(5, 0, "user", "same", 1), (5, 0, "user", "same", 1), (None, 0, "user", "no id", 1), (None, None, "assistant", "first", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree int")
    got = {r.conv_id: r for r in chat.conversation_digests(spark, turns).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own))), conv
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), sha(learned)), conv
    assert chat.conversation_digests(spark, turns.limit(0)).collect() == []


def test_paths_of_trees(spark):
    #  1 - 2 - 4 ; 1 - 3 - 5 ; 6 is a root alone; 7 and 8 are a cycle with 9 below; 10 answers an absent node
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 2, "user", "so", 0.1), ("t", 5, 3, "user", "thanks", None),
            ("t", 6, None, "user", "alone", -1.0), ("t", 7, 8, "user", "c", 0.0), ("t", 8, 7, "user", "c", 0.0), ("t", 9, 8, "user", "c", 0.0), (None, 10, 99, "user", "n", 1.0)]
    rows += [("deep", k, k - 1 if k else None, "user", str(k), 0.0) for k in range(100)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    paths = {}
    for r in chat.reply_paths(spark, messages, best=None).collect():
        paths.setdefault((r.tree, r.rank), []).append((r.place, r.node))
    found = {k: [n for _, n in sorted(v)] for k, v in paths.items()}
    assert found == {("t", 1): [1, 3, 5], ("t", 2): [1, 2, 4], ("t", 3): [6], (None, 1): [10], ("deep", 1): list(range(100))}
    best = chat.format_paths(chat.reply_paths(spark, messages), messages)
    text = {r.tree: r for r in best.collect()}
    assert text["t"].formatted == "### user: q</turn>\n### assistant: good</turn>\n### user: thanks</turn>\n"
    assert [text["t"].formatted[s.start : s.start + s.length] for s in text["t"].loss] == ["good"]


def test_long_conversations_take_linear_time(spark):
    def seconds(n):
        text = "".join(f"### {'assistant' if k % 2 else 'user'}: w{k}</turn>\n" for k in range(n))
        spans, at = [], 0
        for k in range(n):
            head, size = len(f"### {'assistant' if k % 2 else 'user'}: "), len(f"w{k}")
            spans += [(k, at + head, size)] * (k % 2)
            at += head + size + len("</turn>\n")
        row = spark.createDataFrame([(text, spans)], "formatted string, loss array<struct<turn:int,start:bigint,length:int>>")
        start = time.perf_counter()
        found = chat.read_back(row).select(F.sha2("learned", 256).alias("h"), F.size("turns").alias("n")).first()
        assert (found["n"], found["h"]) == (n, sha("".join(f"w{k}" for k in range(1, n, 2))))
        return time.perf_counter() - start

    seconds(10)
    small, large = seconds(5000), seconds(40_000)
    assert large < 5 + 16 * small
