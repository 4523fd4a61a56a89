import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from codescope.operators import errors, report
from codescope.operators.languages import LANGUAGES, PYTHON
from codescope.operators.summarize import answer_prompts, first_line_summary
from codescope.plans.analyze import analyze_tree, collect_from_table
from codescope.sources.tree import list_source_tree, read_contents, read_source_tree
from codescope.streaming import snapshots

TREE = {
    "Cargo.toml": '[package]\nname = "demo"\nversion = "0.1.0"\n',
    "README.md": "# demo\n",
    ".gitignore": "skip/\n",
    "src/main.rs": "use std::io;\npub fn main() {}\n",
    "pkg/__init__.py": "def a():\n" + "    x = 1\n" * 9,
    ".hid/h.py": "import os\n",
    "pkg/_priv/p.py": "class P:\n    pass\n",
    "skip/no.py": "import no\n",
    "target/no.rs": "fn no() {}\n",
    "notes/_x.txt": "",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, (1_700_000_000, 1_700_000_000))
    (root / "loop").symlink_to(root, target_is_directory=True)
    return root


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_listing_finds_hidden_and_underscore_names(spark, tree, slices):
    rows = list_source_tree(spark, str(tree), slices=slices).collect()
    assert sorted(r["rel_path"] for r in rows) == sorted(TREE)
    assert {r["last_modified"] for r in rows} == {1_700_000_000}


def test_listing_prunes_ignored_directories(spark, tree):
    rows = list_source_tree(spark, str(tree), ignore=["target", ".*ignore"]).collect()
    assert sorted(r["rel_path"] for r in rows) == sorted(set(TREE) - {"target/no.rs", ".gitignore"})
    contents = {r["rel_path"]: bytes(r["content"]).decode() for r in read_source_tree(spark, str(tree)).collect()}
    assert contents == TREE


def test_run_over_a_tree(spark, tree, tmp_path):
    where = str(tmp_path / "cache")
    run = analyze_tree(spark, str(tree), where, first_line_summary, "stub")
    got = {os.path.relpath(r["path"], tree): r["analysis"] for r in run.analyses.collect()}
    assert sorted(got) == [".hid/h.py", "pkg/__init__.py", "pkg/_priv/p.py", "src/main.rs"]
    assert got["pkg/__init__.py"]["functions"][0]["summary"] == "def a():"
    assert got["src/main.rs"]["functions"][0]["summary"] == "fn main ()"
    assert run.log.count() == 2
    assert [tuple(r) for r in run.packages.collect()] == [("demo", "0.1.0")]
    assert sorted(os.path.relpath(r["path"], tree) for r in run.documentation.collect()) == ["README.md", "notes/_x.txt"]
    out = report.write_report(run.report(), str(tmp_path / "out"), "demo", "2024-01-01")
    assert os.path.isdir(out)

    # Nothing changed: nothing is asked again. Then one file changes.
    assert analyze_tree(spark, str(tree), where, first_line_summary, "stub").log.count() == 0
    (tree / "pkg/_priv/p.py").write_text("class Q:\n    pass\n")
    again = analyze_tree(spark, str(tree), where, first_line_summary, "stub")
    types = {os.path.relpath(r["path"], tree): r["analysis"]["types"] for r in again.analyses.collect()}
    assert types["pkg/_priv/p.py"] == ["Q"] and again.log.count() == 0


def test_run_without_code_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("x")
    assert analyze_tree(spark, str(tmp_path)) is None


def test_collect_from_table(spark):
    rows = [(f"p/{k}", 1, v) for k, v in TREE.items()]
    files = spark.createDataFrame(rows, "path string, last_modified bigint, content string")
    got = sorted(r["path"] for r in collect_from_table(files).collect())
    assert got == ["p/.hid/h.py", "p/pkg/__init__.py", "p/pkg/_priv/p.py", "p/src/main.rs"]


def test_stream_skips_repeats_and_keeps_newest(spark, tmp_path):
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))

    def drop(rows):
        spark.createDataFrame(rows, "path string, last_modified bigint, content string").coalesce(1).write.mode(
            "append"
        ).parquet(source)
        snapshots.stream_analyze(snapshots.read_snapshots(spark, source), log, state).awaitTermination()

    drop([("a.py", 100_000_000, "import a\n"), ("a.py", 100_000_000, "import a\n"), ("b.md", 1, "")])
    drop([("a.py", 100_000_000, "import a\n"), ("a.py", 100_000_060, "import b\n")])
    # Old by its own time but new to the stream: must not be dropped as late.
    drop([("old.py", 5, "import old\n"), ("a.py", 7, "import stale\n")])
    rows = {r["path"]: r["analysis"]["imports"] for r in snapshots.latest_analyses(spark, log).collect()}
    assert rows == {"a.py": ["b"], "old.py": ["old"]}
    assert spark.read.parquet(log).filter(F.col("last_modified") == 100_000_000).count() == 1
    snapshots.compact(spark, log, str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 2


def analysed(run, tree):
    return {os.path.relpath(r["path"], tree): r for r in run.analyses.collect()}


def test_bad_files_are_rows_and_good_ones_are_kept(spark, tree, tmp_path):
    where = str(tmp_path / "cache")
    assert len(analysed(analyze_tree(spark, str(tree), where), tree)) == 4
    bad = tree / "pkg/_priv/p.py"
    bad.write_bytes(b"\xff\xfe")
    (tree / "pkg/new.py").write_text("import new\n")
    with pytest.raises(ValueError, match="valid UTF-8"):
        analyze_tree(spark, str(tree), where)
    run = analyze_tree(spark, str(tree), where, on_error="quarantine")
    got = analysed(run, tree)
    assert "pkg/_priv/p.py" not in got and got["pkg/new.py"]["analysis"]["imports"] == ["new"]
    assert [(os.path.relpath(e["path"], tree), e["kind"]) for e in run.errors.collect()] == [("pkg/_priv/p.py", "IoError")]


def test_unreadable_files_keep_their_row(spark, tree):
    listing = list_source_tree(spark, str(tree)).cache()
    assert listing.count() == len(TREE)
    (tree / "pkg/__init__.py").unlink()
    rows = {r["rel_path"]: r for r in read_contents(listing).collect()}
    assert len(rows) == len(TREE) and rows["pkg/__init__.py"]["content"] is None
    found = errors.analysis_errors(read_contents(listing).filter(F.col("path").endswith(".py"))).collect()
    assert [(r["kind"], r["message"]) for r in found] == [("IoError", "No such file or directory")]
    assert read_contents(listing, 7).rdd.getNumPartitions() == 7
    listing.unpersist()


def test_cache_tells_body_modes_and_languages_apart(spark, tree, tmp_path):
    where = str(tmp_path / "cache")
    (tree / "src/z.py").write_text("x = 1\n\ndef f():\n    return 1\n")
    body = lambda run: analysed(run, tree)["src/z.py"]["analysis"]["functions"][0]["body"]
    reference = body(analyze_tree(spark, str(tree), where))
    assert body(analyze_tree(spark, str(tree), where, body_mode="block")) != reference
    assert body(analyze_tree(spark, str(tree), where)) == reference
    go = replace(PYTHON, name="go", suffixes=(".go",))
    (tree / "src/m.go").write_text("import fmt\n")
    got = analysed(analyze_tree(spark, str(tree), where, languages=(*LANGUAGES, go)), tree)
    assert got["src/m.go"]["analysis"]["imports"] == ["fmt"] and "src/main.rs" in got


def test_prompts_are_shared_out(spark):
    rows = spark.createDataFrame([(f"f{i}.rs", "rust", 1, f"f{i}", f"fn f{i} ()", "b", 9) for i in range(64)], "path string, language string, ord int, name string, signature string, body string, lines_of_code int")
    seen = rows.select(F.col("name").alias("prompt_id"), F.col("body").alias("prompt")).repartition(5, "prompt_id")
    assert answer_prompts(seen, lambda p: [""] * len(p)).rdd.getNumPartitions() == 5


def test_wide_levels_are_many_tasks(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"d{k}/e").mkdir(parents=True)
        (tmp_path / f"d{k}/e/f.py").write_text("x")
    rows = list_source_tree(spark, str(tmp_path), slices=4)
    assert sorted(r["rel_path"] for r in rows.collect()) == sorted(f"d{k}/e/f.py" for k in range(40))
    tasks = {os.path.dirname(f): 0 for f in rows.inputFiles()}
    assert len(tasks) >= 3 and len(rows.inputFiles()) > 10  # rounds, and tasks in them
    assert list_source_tree(spark, str(tmp_path / "absent")).collect() == []


def test_reads_are_dealt_by_bytes(spark, tree, monkeypatch):
    from codescope.sources import tree as source

    monkeypatch.setattr(source, "_TASK_BYTES", 16)
    listing = list_source_tree(spark, str(tree))
    size = sum(len(t) for t in TREE.values())
    assert read_contents(listing).rdd.getNumPartitions() == max(-(-size // 16), 4)


def test_rule_files_above_the_root_and_bad_ones(spark, tmp_path):
    root = tmp_path / "up/root"
    (root / "sub").mkdir(parents=True)
    (tmp_path / "up/.gitignore").write_text("gone.py\n/root/sub/\n")
    for name in ("Cargo.toml", "a.py", "gone.py", "sub/b.py"):
        (root / name).write_text("import a\n")
    run = analyze_tree(spark, str(root))
    assert [os.path.relpath(r["path"], root) for r in run.analyses.collect()] == ["a.py"]
    (root / ".ignore").write_bytes(b"\xff\xfe")
    with pytest.raises(ValueError, match="valid UTF-8"):
        analyze_tree(spark, str(root))
    run = analyze_tree(spark, str(root), on_error="quarantine")
    assert [(os.path.relpath(r["path"], root), r["kind"]) for r in run.errors.collect()] == [(".ignore", "IoError")]


def test_own_languages_from_a_table(spark):
    go = replace(PYTHON, name="go", suffixes=(".go",))
    files = spark.createDataFrame([("p/Cargo.toml", 1, ""), ("p/a.go", 1, "import fmt\n"), ("p/b.py", 1, "")], "path string, last_modified bigint, content string")
    got = collect_from_table(files, languages=(*LANGUAGES, go)).select("path").collect()
    assert sorted(r["path"] for r in got) == ["p/a.go", "p/b.py"]


def test_streamed_tree_reads_edits_once(spark, tmp_path):
    from codescope.streaming.tree_source import stream_source_tree

    root, listings, state, out = (str(tmp_path / n) for n in ("root", "listings", "state", "out"))
    os.makedirs(f"{root}/p")
    put = lambda name, text: open(f"{root}/{name}", "w").write(text)
    put("a.py", "import a\n"), put("p/b.py", "import b\n"), put("c.md", "no\n")

    def run():
        stream = stream_source_tree(spark, root, listings, suffixes=(".py",))
        snapshots.stream_analyze(stream, out, state).awaitTermination()
        return sorted((os.path.relpath(r["path"], root), r["analysis"]["imports"][0]) for r in spark.read.parquet(out).select("path", "analysis").collect())

    assert run() == [("a.py", "a"), ("p/b.py", "b")]
    assert run() == [("a.py", "a"), ("p/b.py", "b")]  # nothing changed: no row
    put("a.py", "import edited\n"), put("new.py", "import n\n")
    os.utime(f"{root}/a.py", (2e9, 2e9))
    assert run() == [("a.py", "a"), ("a.py", "edited"), ("new.py", "n"), ("p/b.py", "b")]
    assert len([f for f in os.listdir(listings) if f.endswith(".parquet")]) <= 2


def test_listings_replay_the_same_files(tmp_path):
    from codescope.streaming.tree_source import TreeStreamReader

    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text("1")
    reader = TreeStreamReader({"path": str(root), "listings": str(tmp_path / "l")})
    one = reader.latestOffset()
    assert reader.latestOffset() == one
    (root / "b.py").write_text("2")
    two = reader.latestOffset()
    again = TreeStreamReader({"path": str(root), "listings": str(tmp_path / "l")})  # after a restart
    paths = lambda r, a, b: [os.path.basename(p) for part in r.partitions(a, b) for p, _ in part.files]
    assert paths(reader, one, two) == paths(again, one, two) == ["b.py"]
    assert paths(again, reader.initialOffset(), two) == ["a.py", "b.py"]
    again.commit(two)
    assert again.latestOffset() == two
