import pytest
from pyspark.sql import functions as F

from codescope.functions import paths
from codescope.functions.globs import gitignore_rule, glob_regex
from codescope.operators import directories, gitignore, selection
from codescope.plans.analyze import collect_code_files


def table(spark, rows, schema="path string"):
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def paths_of(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_path_parts(spark):
    df = table(spark, ["/w/a/x.py", "a.py", "./a/.rs", "a/b.c/n", "a/t.tar.ts"])
    rows = df.select(
        paths.name_of(F.col("path")), paths.directory_of(F.col("path")), paths.extension_of(F.col("path")),
        paths.ancestors_of(paths.directory_of(F.col("path"))), paths.top_directory_of(F.col("path")),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("x.py", "/w/a", "py", ["", "/w", "/w/a"], ""),
        ("a.py", "", "py", [""], ""),
        (".rs", "./a", "", ["", ".", "./a"], "."),
        ("n", "a/b.c", "", ["", "a", "a/b.c"], "a"),
        ("t.tar.ts", "a", "ts", ["", "a"], "a"),
    ]


def test_code_files_and_language(spark):
    df = table(spark, ["a.rs", ".rs", "b.tsx", "c.ts", "d.PY", "e.py", "f.js", "g.mjs", "h"])
    assert paths_of(selection.code_files(df)) == ["a.rs", "c.ts", "e.py", "f.js"]
    # The language goes by suffix, so a bare ".rs" has one although it is no code file.
    langs = {r["path"]: r["l"] for r in df.select("path", selection.language(F.col("path")).alias("l")).collect()}
    assert langs[".rs"] == "rust" and langs["c.ts"] == "javascript" and langs["d.PY"] is None
    assert paths_of(selection.unsupported_files(df)) == ["b.tsx", "d.PY", "g.mjs", "h"]
    docs = table(spark, ["README.md", "a/notes.txt", "b.rst", "c.MD", "d.md.py"])
    assert paths_of(selection.documentation_files(docs)) == ["README.md", "a/notes.txt", "b.rst"]


@pytest.mark.parametrize(
    "path, root, ignored",
    [
        ("./a/b-ignore", "", True),  # "*" crosses "/" against the full path
        ("a/b-ignore", "", False),
        ("a/.xignore/b.py", "", True),
        ("/w/build/p/a.py", "/w/build/p", True),  # the root's own components count
        ("src/rebuild/a.py", "", False),
        ("src/a.log", "", True),
        ("src/a.log.py", "", False),
        ("x.tmp/a.py", "", True),
    ],
)
def test_default_ignore(spark, path, root, ignored):
    df = table(spark, [path])
    assert (paths_of(selection.drop_ignored(df, root=root)) == []) is ignored


def test_custom_ignore_adds_to_defaults_and_prunes_below(spark):
    df = table(spark, ["src/gen/x/a.py", "src/other/a.py", "node_modules/a.py", "q/src/gen/a.py"])
    assert paths_of(selection.drop_ignored(df, ["src/gen"])) == ["q/src/gen/a.py", "src/other/a.py"]
    # A pattern that only matches something above the root does not count.
    below = table(spark, ["/data/corpus/a.py"])
    assert paths_of(selection.drop_ignored(below, ["/data"], root="/data/corpus")) == ["/data/corpus/a.py"]
    assert paths_of(selection.drop_ignored(below, ["/data"])) == []


def test_globs():
    import re

    def hit(glob, path, crosses=False):
        return re.fullmatch("(?s)" + glob_regex(glob, crosses), path) is not None

    assert hit("*.{js,ts}", "a.ts") and not hit("*.{js,ts}", "a.py")
    assert hit("[!a]b", "cb") and not hit("[!a]b", "ab")
    assert hit("a*c", "a/c", True) and not hit("a*c", "a/c")
    assert hit("**/x", "x") and hit("**/x", "a/b/x") and hit("a/**", "a/b/c") and hit("a/**/b", "a/b")
    assert hit(r"\*a", "*a") and hit("a?c", "abc")
    assert gitignore_rule("# x") is None and gitignore_rule("  ") is None
    assert gitignore_rule("[z-a].py") is None
    assert gitignore_rule("!keep/")[1:] == (True, True)
    assert re.match(gitignore_rule("/a.py")[0].replace(r"\z", r"\Z"), "b/a.py") is None


def test_code_directories(spark):
    df = table(
        spark,
        ["p/Cargo.toml", "p/src/a.rs", "q/a.py", "q/deep/setup.py", "node_modules/m/package.json", "r/package.json/x",
         "setup.py"],
    )
    dirs = directories.code_directories(df)
    assert sorted(r["dir"] for r in dirs.collect()) == ["", "p", "q/deep", "r"]
    nested = directories.code_directories(df.filter("path <> 'setup.py'"))
    assert paths_of(directories.in_code_directory(df, nested)) == [
        "p/Cargo.toml", "p/src/a.rs", "q/deep/setup.py", "r/package.json/x"
    ]
    assert len(paths_of(directories.in_code_directory(df, dirs))) == df.count()


RULES = [
    (".gitignore", "*.log\n/top.py\ngen/\n# note\n!keep.log\n"),
    ("a/.gitignore", "!x.log\nlocal\\ \nb/c.py\n"),
    ("a/.ignore", "z.py\nw.log\n"),
]


def test_gitignore_precedence(spark):
    rules = gitignore.ignore_rules(table(spark, RULES, "path string, content string"))
    files = table(
        spark,
        ["m.log", "keep.log", "top.py", "a/top.py", "gen/a.py", "a/gen/deep/a.py", "a/gen.py", "a/x.log", "x.log",
         "a/b/c.py", "a/q/b/c.py", "a/z.py", "z.py", "a/w.log", "gen"],
    )
    assert paths_of(gitignore.apply_gitignore(files, rules)) == [
        "a/gen.py", "a/q/b/c.py", "a/top.py", "a/x.log", "gen", "keep.log", "z.py"
    ]


def test_code_directory_inside_an_ignored_one_is_walked(spark):
    files = table(spark, ["Cargo.toml", "vendor/a.py", "vendor/lib/Cargo.toml", "vendor/lib/src/b.rs", "src/c.rs"])
    rules = table(spark, [(".gitignore", "vendor/\n")], "path string, content string")
    assert paths_of(collect_code_files(files, rules)) == ["src/c.rs", "vendor/lib/src/b.rs"]


def test_nested_code_directories_do_not_repeat_files(spark):
    files = table(spark, ["Cargo.toml", "sub/package.json", "sub/a.js", "b.rs", "target/x.rs"])
    assert paths_of(collect_code_files(files)) == ["b.rs", "sub/a.js"]


def test_distinct_and_empty(spark):
    df = table(spark, [("a.py", 1, "x"), ("a.py", 2, "y"), ("b.py", 1, "z")], "path string, last_modified bigint, content string")
    assert sorted(map(tuple, selection.distinct_files(df).collect())) == [("a.py", 2, "y"), ("b.py", 1, "z")]
    assert selection.require_nonempty(df) and not selection.require_nonempty(df.filter("path = 'no'"))


def test_full_globs_reach_any_depth(spark):
    deep = "./" + "d" * 100 + "/" + "/".join(["e" * 49] * 100) + "/b-ignore/x.py"
    rows = spark.createDataFrame([(deep,), ("./a/b-ignore/x.py",), ("./a/x.py",)], "path string")
    kept = rows.filter(~selection.is_ignored(F.col("path"), ["./**/b-ignore"], ".")).collect()
    assert len(deep) > 5000 and [r["path"] for r in kept] == ["./a/x.py"]


def tree_of(rng, n):
    names = ["a", "b", "a b", "a.b", "gen", "é", "x.log", "keep"]
    return sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(0, 6))) + "/" * (k % 2) + f"f{k % 40}.{rng.choice(['py', 'log'])}" for k in range(n)})


def brute_ignored(path, rules, code_dirs):
    """Straight from the rules: every directory on the way down, then the file."""
    above = ["", *(path[:i] for i, c in enumerate(path) if c == "/" and i)]

    def skips(entry, holders, is_dir):
        import re

        for name in (".gitignore", ".ignore"):
            for holder in reversed(holders):
                below = entry[len(holder) + 1 :] if holder else entry.removeprefix("/")
                hits = [r for line in rules.get((holder, name), "").split("\n") if (r := gitignore_rule(line)) and (is_dir or not r[2]) and re.match(r[0].replace(r"\z", r"\Z"), below)]
                if hits:
                    return not hits[-1][1]
        return False

    cut = max((k for k in range(1, len(above)) if skips(above[k], above[:k], True)), default=-1)
    start = max((k for k, d in enumerate(above) if d in code_dirs), default=-1)
    return cut > start or skips(path, above, False)


@pytest.mark.parametrize("seed", [0, 1])
def test_walk_equals_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    paths = tree_of(rng, 400)
    dirs = sorted({p[:i] for p in paths for i, c in enumerate(p) if c == "/" and i} | {""})
    lines = ["*.log", "!keep/", "gen/", "/a", "a b/", "!x.log", "b/*.py", "f1*", "**/é", "!f11.py"]
    rules = {(rng.choice(dirs), rng.choice([".gitignore", ".ignore"])): "\n".join(rng.sample(lines, 3)) for _ in range(12)}
    code_dirs = rng.sample(dirs, 8)
    table_of_rules = gitignore.ignore_rules(table(spark, [(f"{d}/{n}".removeprefix("/"), t) for (d, n), t in rules.items()], "path string, content string"))
    marked = table(spark, code_dirs, "dir string")
    files = table(spark, paths + paths[:5])
    assert paths_of(gitignore.apply_gitignore(files, table_of_rules)) == sorted(p for p in paths + paths[:5] if not brute_ignored(p, rules, ()))
    assert paths_of(gitignore.apply_gitignore(files, table_of_rules, marked)) == sorted(p for p in paths + paths[:5] if not brute_ignored(p, rules, code_dirs))
    inside = [p for p in paths if any(not d or p.startswith(d + "/") for d in code_dirs[:3])]
    assert paths_of(directories.in_code_directory(table(spark, paths), marked.limit(3))) == inside
    assert paths_of(directories.in_code_directory(table(spark, paths), marked.limit(0))) == []


def test_paths_meet_no_directory_key(spark):
    """Paths are dealt out by ranges and met by path; only marks meet the few directories above the ranges' starts."""
    files = table(spark, tree_of(__import__("random").Random(3), 200))
    rules = gitignore.ignore_rules(table(spark, RULES, "path string, content string"))
    plan = gitignore.apply_gitignore(files, rules, table(spark, ["a"], "dir string"))._jdf.queryExecution()
    logical, physical = plan.optimizedPlan().toString(), plan.executedPlan().toString()
    assert "Generate" not in physical
    keys = [line.split("hashpartitioning(")[1].split("#")[0] for line in physical.split("\n") if "hashpartitioning(" in line]
    assert set(keys) <= {"path", "dir", "at"} and "Repartition" in logical and "part" in logical


def test_a_root_rule_file_moves_once_for_each_range(spark):
    """A thousand rules at the top, many directories: the rows that travel with rules are as many as ranges."""
    from codescope.operators import intervals

    paths = [f"d{k}/e/f.py" for k in range(3000)]
    rules = gitignore.ignore_rules(table(spark, [(".gitignore", "\n".join(f"n{k}" for k in range(1000)))], "path string, content string"))
    seen = spark.sparkContext.accumulator(0)

    class Counted(gitignore._Unignored):
        def mark(self, row):
            seen.add(1)
            super().mark(row)

    kept = intervals.walk(table(spark, paths), rules.select("dir", "rank", "rules"), lambda: Counted(False))
    assert kept.count() == 3000
    assert seen.value <= int(spark.conf.get("spark.sql.shuffle.partitions"))
