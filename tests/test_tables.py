from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from codescope.functions import prompts as P
from codescope.operators import cache, errors, extract, metrics, report, rollups, summarize
from codescope.operators import prompts as prompt_tables
from codescope.operators.languages import LANGUAGES, LanguageExtractor
from codescope.sources import manifests
from codescope.sources.tables import files_from_table

PY = "import os\ndef f(a):\n" + "".join(f"    x{i} = a\n" for i in range(8)) + "\nclass K:\n    pass\n"
JS = 'import "m";\nexport const g = (a) => {\n  return a\n}\n'
RS = "use a::b;\npub fn h(x: u8) -> u8 { x }\n"
FILES = [("a.py", 10, PY), ("b.js", 20, JS), ("c.rs", 30, RS), ("d.ts", 40, "")]


@pytest.fixture
def files(spark):
    return spark.createDataFrame(FILES, "path string, last_modified bigint, content string")


def test_assemble_keeps_files_without_findings(files):
    rows = {r["path"]: r["analysis"] for r in extract.assemble_analysis(files).collect()}
    assert rows["d.ts"] == ([], [], [], [])
    assert rows["a.py"]["imports"] == ["os"] and rows["a.py"]["types"] == ["K"]
    assert [f["name"] for f in rows["b.js"]["functions"]] == ["g"]
    assert rows["c.rs"]["exports"] == ["fn h"]


def test_exploded_tables_agree_with_stored_analyses(files):
    stored = extract.assemble_analysis(files)
    for part in extract.PARTS:
        direct = extract.part_table(files, part).collect()
        assert sorted(map(str, direct)) == sorted(map(str, extract.explode_analysis(stored, part).collect()))


def test_own_language_extractor(files):
    sql = LanguageExtractor(
        "sql", (".sql",), lambda c: F.array().cast("array<string>"),
        lambda c, mode: F.array().cast(extract.PARTS["functions"]),
        lambda c: F.regexp_extract_all(c, F.lit(r"(?i)create table (\w+)"), F.lit(1)),
        lambda c: F.array().cast("array<string>"), lambda f: F.lit(False),
    )
    more = files.sparkSession.createDataFrame([("x.sql", 1, "CREATE TABLE t (a int)")], files.schema)
    rows = extract.types(more.unionByName(files), (*LANGUAGES, sql)).collect()
    assert ("x.sql", "sql", 1, "t") in [tuple(r) for r in rows]


def test_errors_and_checks(spark):
    df = spark.createDataFrame(
        [("a.py", bytearray(b"ok")), ("b.py", bytearray(b"\xff\xfe")), ("c.rs", bytearray(b"fn f() {")), ("d.md", bytearray(b"#"))],
        "path string, content binary",
    )
    found = {r["path"]: (r["kind"], r["message"]) for r in errors.analysis_errors(df).collect()}
    assert found == {
        "b.py": ("IoError", errors.BAD_TEXT),
        "c.rs": ("AnalysisError", errors.BAD_BRACKETS),
        "d.md": ("AnalysisError", "No suitable analyzer found for file: d.md"),
    }
    assert [tuple(r) for r in errors.check_files(df, "quarantine").collect()] == [("a.py", "ok")]
    with pytest.raises(Exception, match="IoError|AnalysisError"):
        errors.check_files(df, "fail").collect()


def test_cache_round(spark, files, tmp_path):
    where = str(tmp_path / "cache")
    empty = cache.read_analysis_cache(spark, where)
    first = cache.incremental_analyze(files, empty)
    assert first.filter("cached").count() == 0
    cache.write_analysis_cache(cache.next_cache(first, empty), where)
    stored = cache.read_analysis_cache(spark, where)
    assert cache.cache_misses(files, stored).count() == 0
    again = cache.incremental_analyze(files, stored)
    assert again.filter("NOT cached").count() == 0
    assert sorted(map(str, again.select("path", "analysis").collect())) == sorted(
        map(str, first.select("path", "analysis").collect())
    )
    # One file older by a second, one gone: equality decides, and old entries stay unless evicted.
    changed = files.filter("path <> 'c.rs'").withColumn(
        "last_modified", F.when(F.col("path") == "a.py", F.col("last_modified") - 1).otherwise(F.col("last_modified"))
    )
    hits, misses = cache.cache_hits(changed, stored), cache.cache_misses(changed, stored)
    assert sorted(r["path"] for r in misses.collect()) == ["a.py"]
    assert hits.count() + misses.count() == changed.count()
    assert [r["path"] for r in cache.stale_cache(changed, stored).collect()] == ["c.rs"]
    results = cache.incremental_analyze(changed, stored)
    assert cache.next_cache(results, stored).count() == 4
    assert cache.next_cache(results, stored, evict=True).count() == 3
    cache.write_analysis_cache(cache.next_cache(results, stored, evict=True), where)
    assert cache.read_analysis_cache(spark, where).count() == 3


def test_unfinished_cache_version_is_not_read(spark, files, tmp_path):
    where = tmp_path / "cache"
    cache.write_analysis_cache(extract.assemble_analysis(files), str(where))
    (where / "version=2").mkdir()
    (where / "version=2" / "part-0.parquet").write_bytes(b"broken")
    assert cache.read_analysis_cache(spark, str(where)).count() == 4


def entries(spark, where):
    return sorted((r["path"], r["last_modified"]) for r in cache.read_analysis_cache(spark, where).collect())


def test_cache_deltas(spark, files, tmp_path):
    where = str(tmp_path / "cache")
    full = extract.assemble_analysis(files).select("path", "last_modified", F.lit("v").alias("fingerprint"), "analysis")
    at = lambda path, t: full.filter(F.col("path") == path).withColumn("last_modified", F.lit(t).cast("bigint"))
    assert cache.append_analysis_cache(full, where) == 1
    before = entries(spark, where)
    assert len(before) == full.count()
    # A run without changes writes no row and no commit; a changed file is one row of one delta.
    assert cache.append_analysis_cache(full.limit(0), where) is None and entries(spark, where) == before
    assert cache.append_analysis_cache(at("a.py", 5), where) == 2
    assert cache.append_analysis_cache(at("a.py", 6), where, removed=full.filter("path = 'c.rs'").select("path")) == 3
    after = sorted((p, 6 if p == "a.py" else t) for p, t in before if p != "c.rs")
    assert entries(spark, where) == after
    rows = [spark.read.parquet(str(d)).count() for d in (tmp_path / "cache").glob("data-*")]
    assert sorted(rows) == sorted([len(before), 0, 1, 2])
    assert cache.compact_analysis_cache(spark, where) == 4 and entries(spark, where) == after
    assert cache.compact_analysis_cache(spark, where) is None
    assert cache.append_analysis_cache(at("c.rs", 9), where) == 5
    assert entries(spark, where) == sorted([*after, ("c.rs", 9)])


def test_two_writers_never_share_a_version(spark, files, tmp_path):
    where = str(tmp_path / "cache")
    log = cache._Log(spark, where)
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda k: log.add({"kind": "delta", "data": f"d{k}"}), range(24)))
    assert sorted(numbers) == list(range(1, 25)) == log.numbers()
    assert sorted(log.read(n)["data"] for n in numbers) == sorted(f"d{k}" for k in range(24))
    assert not log.put(7, {"kind": "base"})


def test_deltas_during_a_compaction_are_kept(spark, files, tmp_path, monkeypatch):
    where = str(tmp_path / "cache")
    full = extract.assemble_analysis(files).select("path", "last_modified", "analysis")
    cache.append_analysis_cache(full, where)
    write = cache._write_data

    def slow(rows, path):
        name = write(rows, path)
        monkeypatch.setattr(cache, "_write_data", write)
        cache.append_analysis_cache(full.limit(1).withColumn("last_modified", F.lit(77).cast("bigint")), where)  # another writer
        return name

    monkeypatch.setattr(cache, "_write_data", slow)
    assert cache.compact_analysis_cache(spark, where) == 3
    assert sum(t == 77 for _, t in entries(spark, where)) == 1 and len(entries(spark, where)) == full.count()


def test_fingerprint_joins_the_key(files):
    old = files.select("path", "last_modified", F.lit("v1").alias("fingerprint"))
    assert cache.cache_misses(files.withColumn("fingerprint", F.lit("v2")), old).count() == 4
    assert cache.cache_misses(files.withColumn("fingerprint", F.lit("v1")), old).count() == 0


def test_bucketed_tables_join_without_shuffle(spark, files):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cache.save_by_path(files, "files_by_path", 4)
        cache.save_by_path(extract.assemble_analysis(files), "cache_by_path", 4)
        result = cache.incremental_analyze(spark.table("files_by_path"), spark.table("cache_by_path"))
        assert "Exchange" not in result._jdf.queryExecution().executedPlan().toString()
        assert result.filter("cached").count() == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS files_by_path")
        spark.sql("DROP TABLE IF EXISTS cache_by_path")


def test_manifests(spark):
    rows = [
        ("package.json", '{"name": "n", "version": "1.2"}'),
        ("Cargo.toml", '[dependencies]\nname = "no"\n\n[ package ] # main\nversion = \'0.3\'\nname = "c\\"q" # x\nedition = "2021"\n[lib]\nname = "no"\n'),
        ("sub/package.json", '{"name": 5, "version": "1"}'),
        ("bad/package.json", "{"),
        ("sub/Cargo.toml", "package.name = \"dotted\"\npackage.version = \"9\"\n"),
        ("ws/Cargo.toml", "[package]\nname = \"w\"\nversion.workspace = true\n"),
    ]
    df = spark.createDataFrame(rows, "path string, content string")
    assert [tuple(r) for r in manifests.npm_packages(df).collect()] == [("package.json", "n", "1.2")]
    assert [tuple(r) for r in manifests.cargo_packages(df).collect()] == [("Cargo.toml", 'c"q', "0.3")]
    every = sorted(tuple(r) for r in manifests.packages(df, all_levels=True).collect())
    assert every == [('c"q', "0.3"), ("dotted", "9"), ("n", "1.2")]
    assert manifests.project_name(df, "f").first()[0] == 'c"q'
    assert manifests.project_name(df, "f", root="bad").first()[0] == "f"
    assert manifests.project_name(df, root="none").first()[0] == "unknown"
    same = spark.createDataFrame(
        [("package.json", '{"name": "n", "version": "1"}'), ("Cargo.toml", '[package]\nname = "n"\nversion = "2"\n')],
        "path string, content string",
    )
    assert [tuple(r) for r in manifests.packages(same).collect()] == [("n", "2")]


def test_files_from_table(spark):
    df = spark.sql("SELECT 'a.py' AS p, timestamp'1970-01-02 00:00:01.9' AS t, 'x' AS c")
    assert tuple(files_from_table(df, "p", "t", "c").first()) == ("a.py", 86401, "x")


def test_report_text(spark, files, tmp_path):
    one = files.filter("path = 'b.js'")
    docs = spark.createDataFrame([("README.md",)], "path string")
    packages = spark.createDataFrame([("n", "1")], "name string, version string")
    blocks = report.report_blocks(docs, packages, extract.assemble_analysis(one))
    want = (
        "# Code Summary\n\n## Documentation Files\n- README.md\n\n## Package Information\n- n: 1\n\n## Code Analysis\n"
        "## b.js\n\n**Imports:**\n- m\n\n**Functions:**\n- g\n  Signature: const g = (a)=> \n  Lines of code: 3\n"
        "  Cyclomatic complexity: 1\n  Parameters: 1\n  Returns: false\n\n**Exports:**\n- g\n\n\n\n"
    )
    lines = report.render_report(docs, packages, extract.assemble_analysis(one)).orderBy("section_ord", "path", "ord")
    assert "".join(r["line"] + "\n" for r in lines.collect()) == want
    folder = report.write_report(blocks, str(tmp_path), "proj", "2024-05-06")
    assert folder.endswith("/summary-proj-2024-05-06.md")
    parts = sorted(p for p in (tmp_path / "summary-proj-2024-05-06.md").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts) == want
    assert report.report_name("p", "d", "{date}_{folder}.txt") == "d_p.txt"


def test_report_types_and_summary(spark, files):
    stored = extract.assemble_analysis(files.filter("path = 'a.py'"))
    filled = stored.withColumn(
        "analysis",
        F.col("analysis").withField("functions", F.transform("analysis.functions", lambda f: f.withField("summary", F.lit("S")))),
    )
    text = filled.select(report.file_block(F.col("path"), F.col("analysis"))).first()[0]
    assert "  Returns: false\n  Summary: S\n\n" in text and "**Types:**\n```rust\nK\n```\n\n\n\n" in text


def test_prompts(spark, files):
    rows = {r["name"]: r["prompt"] for r in prompt_tables.with_prompt(extract.functions(files)).collect()}
    assert rows["g"].startswith("Summarize the following JavaScript/TypeScript function:\n\nName: g\nSignature: const g = (a)=> \nBody:  {\n")
    assert "\nTypes: \nBody:     x0 = a\n" in rows["f"]
    assert rows["h"] == "Summarize the following Rust function:\n\nName: h\nSignature: fn h (x : u8) -> u8\nTypes: u8\nBody: { x }"
    large = spark.createDataFrame([("n", "s", "t", "\n".join("abcdefg"))], "n string, s string, t string, b string")
    text = large.select(P.build_large_prompt(*map(F.col, "nstb"))).first()[0]
    assert text == (
        "Summarize this large Rust function:\n\nName: n\nSignature: s\nTypes: t\n\nFunction body in parts:\n"
        "\nPart 1:\na\nb\nc\nd\ne\n\nTypes: t\n\nPart 2:\nf\ng\n\nTypes: t\n"
        "\nPlease provide a summary of the function's purpose and behavior based on these parts."
    )


def test_summarize_asks_each_prompt_once(spark, tmp_path):
    # The same long function in many files, as in vendored copies.
    files = spark.range(50).select(
        F.concat(F.lit("p"), F.col("id").cast("string"), F.lit(".py")).alias("path"),
        F.lit(1).cast("bigint").alias("last_modified"), F.lit(PY).alias("content"),
    )
    calls = tmp_path / "calls"
    calls.mkdir()

    def note(prompts, folder=str(calls)):
        import uuid
        from pathlib import Path

        Path(folder, uuid.uuid4().hex).write_text(str(len(prompts)))
        return summarize.first_line_summary(prompts)

    done, log = summarize.summarize(extract.functions(files), note, "stub")
    rows = done.collect()
    assert len(rows) == 50 and all(r["summary"] == "def f(a):" for r in rows)
    assert log.count() == 1 and log.first()["model"] == "stub" and log.first()["output_tokens"] == 2
    assert sum(int(p.read_text()) for p in calls.iterdir()) == 1


def test_short_functions_get_no_summary(files):
    done, log = summarize.summarize(extract.functions(files), summarize.first_line_summary)
    got = {r["name"]: r["summary"] for r in done.collect()}
    assert got == {"f": "def f(a):", "g": None, "h": "fn h (x : u8) -> u8"}
    assert log.count() == 2


def test_responses(spark):
    rows = [
        ("generate", '{"response": "a"}'), ("generate", '{"response": 5}'), ("generate", "{}"), ("chat", '{"choices": []}'),
        ("chat", '{"choices": [{"message": {"content": "b"}}]}'), ("chat", "no json"),
    ]
    df = spark.createDataFrame(rows, "p string, b string")
    assert [r[0] for r in df.select(P.extract_response(F.col("p"), F.col("b"))).collect()] == ["a", "", "", "", "b", None]


def test_metrics(spark):
    log = spark.createDataFrame(
        [("1", "m", 2.0, 10, 4), ("2", "m", 0.0, 1, 1), ("3", "n", 1.0, 5, 5)],
        "call_id string, model string, duration_s double, input_tokens bigint, output_tokens bigint",
    )
    assert [r["tokens_per_second"] for r in metrics.call_metrics(log).orderBy("call_id").collect()] == [7.0, None, 10.0]
    rows = {r["model"]: r for r in metrics.inference_metrics(log).collect()}
    assert rows["m"]["total_tokens"] == 16 and rows["m"]["tokens_per_second"] == 8.0


def test_rollups(spark, files):
    rows = {r["language"]: r for r in rollups.language_rollup(extract.functions(files)).collect()}
    assert rows[None]["files"] == 3 and rows["python"]["sum_loc"] == 8
    exports = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("a", "x")], "path string, export string")
    got = sorted(tuple(r) for r in rollups.export_index(exports).select("export", "path", "files", "duplicated").collect())
    assert got == [("x", "a", 2, True), ("x", "b", 2, True), ("y", "a", 1, False)]
    imports = spark.createDataFrame([("a", "i"), ("a", "i"), ("b", "i"), ("b", "j")], "path string, import string")
    assert [tuple(r) for r in rollups.import_usage(imports, 1).collect()] == [("i", 2, 3)]
    docs, code = (spark.createDataFrame([(p,) for p in ps], "path string") for ps in (["a/x.md", "r.md"], ["a/y.py"]))
    cover = sorted(tuple(r) for r in rollups.documentation_coverage(docs, code).collect())
    assert cover == [("", 1, 0), ("a", 1, 1)]


def blocks_of(spark, n):
    rows = [(6, f"p{k:04d}.py", f"## p{k:04d}.py\n\nü {k}\n\r\n\n") for k in range(n)] + [(0, "", "# Code Summary\n\n")]
    return spark.createDataFrame(rows, "section_ord int, path string, text string").repartition(7)


def test_report_is_published_whole(spark, tmp_path):
    from codescope.sources import report_sink

    target = str(tmp_path / "out/report.md")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables, yet several parts
    report_sink.publish_report(blocks_of(spark, 300), target)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    def read():
        rows = sorted((r["number"], r["line"]) for r in report_sink.read_report(spark, target).collect())
        assert [n for n, _ in rows] == list(range(1, len(rows) + 1))
        return "".join(line + "\n" for _, line in rows)

    want = lambda n: "".join(r["text"] for r in blocks_of(spark, n).orderBy("section_ord", "path").collect())
    assert read() == want(300)
    assert len(report_sink._manifest(target)) > 1

    # A task fails: nothing of that attempt is left, the report is as it was.
    bad = blocks_of(spark, 50).withColumn("text", F.when(F.col("path") == "p0040.py", F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        report_sink.publish_report(bad, target)
    assert read() == want(300)
    assert len(list((tmp_path / "out/report.md").glob("parts-*"))) == 1
    report_sink.publish_report(blocks_of(spark, 20), target)
    assert read() == want(20) and len(list((tmp_path / "out/report.md").glob("parts-*"))) == 1
    report_sink.publish_report(blocks_of(spark, 20).limit(0), target)
    assert read() == ""


def test_answers_are_kept_across_runs(spark, tmp_path):
    schema = "path string, language string, ord int, name string, signature string, types string, body string, lines_of_code bigint, cyclomatic_complexity bigint, parameters bigint, returns boolean, summary string"
    rows = [(f"p{k}.rs", "rust", 1, "same" if k < 40 else f"f{k}", f"fn f{min(k, 40) if k < 40 else k} ()" if k >= 40 else "fn same ()", "", "b", 9, 1, 0, False, None) for k in range(50)]
    functions, store = spark.createDataFrame(rows, schema), str(tmp_path / "store")
    sent = spark.sparkContext.accumulator(0)

    def model(prompts):
        sent.add(len(prompts))
        if any("f45" in p for p in prompts):
            raise RuntimeError("overloaded")
        return [p.split("\nSignature: ")[1].split("\n")[0] for p in prompts]

    run = lambda f: summarize.summarize(functions, f, "m", batch_size=1, store=store, attempts=2)
    done, log = run(model)
    got = {r["path"]: r["summary"] for r in done.collect()}
    assert len(got) == 50 and got["p3.rs"] == "fn same ()" and got["p45.rs"] is None and log.count() == 10
    assert sent.value == 10 + 2  # eleven prompts, the failing one twice
    assert [r["error"] for r in summarize.failed_answers(spark, store, "m").collect()] == ["RuntimeError: overloaded"]

    # Again: only the failed prompt is sent; another model asks for itself.
    done, log = run(lambda p: [f"late {len(p)}"] * len(p))
    assert log.count() == 1 and {r["path"]: r["summary"] for r in done.collect()}["p45.rs"] == "late 1"
    assert summarize.failed_answers(spark, store, "m").count() == 0
    assert run(model)[1].count() == 0 and sent.value == 12
    assert summarize.summarize(functions, summarize.first_line_summary, "other", store=store)[1].count() == 11


def test_inline_package_tables(spark):
    rows = [("a/Cargo.toml", 'package = { name = "a, b", version = "1" }\n[dependencies]\nname = "no"\n'), ("b/Cargo.toml", "package = { version = '2', name = 'q' }"), ("c/Cargo.toml", 'x = { name = "n", version = "3" }\n')]
    found = manifests.cargo_packages(spark.createDataFrame(rows, "path string, content string"), all_levels=True).collect()
    assert sorted(map(tuple, found)) == [("a/Cargo.toml", "a, b", "1"), ("b/Cargo.toml", "q", "2")]


def test_spread_join_sends_no_repeated_table_to_every_task(spark):
    from codescope.operators.spread import spread_join

    big = spark.range(200).selectExpr("cast(id % 3 as string) k", "id")
    small = spark.createDataFrame([("0", "a"), ("1", "b")], "k string, v string")
    joined = spread_join(big, small, "k")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(joined.collect()) == sorted(big.join(small, "k", "left").select(joined.columns).collect())
