"""One registered query per operator: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.functions import javascript_source, prompts, python_source, text
from codescope.operators import (
    cache, directories, errors, extract, gitignore, metrics, report, rollups, selection, summarize,
)
from codescope.operators import prompts as prompt_tables
from codescope.operators.languages import JAVASCRIPT, LANGUAGES, PYTHON, RUST
from codescope.plans import analyze
from codescope.schema import ANALYSIS
from codescope.scratch import scratch_folder, write_through
from codescope.sources import manifests, report_sink, tables, tree
from codescope.streaming import snapshots

from .fixtures import base_table, fixture

Query = Callable[[SparkSession, str], DataFrame]
FUNCTION_COLUMNS = (
    "path", "ord", "name", "signature", "types", "lines_of_code", "cyclomatic_complexity", "parameters", "returns",
)


def _per_document(name: str, column: Callable) -> Query:
    return lambda spark, d: base_table(spark, d, "documents").select("doc_id", column(F.col("text")).alias(name))


def _tree(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: build(fixture(spark, d, "tree_files"))


def _code(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: build(fixture(spark, d, "code_files"))


def _part(lang, part: str, *columns: str) -> Query:
    return _code(lambda files: extract.part_table(files, part, [lang]).select(*columns))


def _page_braces(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return base_table(spark, sf_dir, "pages").select(
        "page_id",
        text.count_of(html, "{").cast("bigint").alias("opened"),
        text.count_of(html, "}").cast("bigint").alias("closed"),
    )


def _cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fixture(spark, sf_dir, "code_files"), fixture(spark, sf_dir, "analysis_cache")


def _cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.cache_hits(*_cached(spark, sf_dir)).select("path", "last_modified", "payload")


def _cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, stored = _cached(spark, sf_dir)
    return cache.cache_misses(files.select("path", "last_modified"), stored)


def _stale_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.stale_cache(*_cached(spark, sf_dir))


def _incremental_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, stored = _cached(spark, sf_dir)
    # A stored analysis is recognised by its payload as the only import.
    analysis = F.struct(
        F.array("payload").alias("imports"), F.array().alias("functions"), F.array().alias("types"),
        F.array().alias("exports"),
    ).cast(ANALYSIS)
    result = cache.incremental_analyze(files, stored.select("path", "last_modified", analysis.alias("analysis")))
    return result.select(
        "path", "last_modified", "cached",
        F.size("analysis.functions").cast("bigint").alias("functions"),
        F.get("analysis.imports", F.lit(0)).alias("first_import"),
    )


def _stream_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, log, state = (scratch_folder(spark, p) for p in ("snapshots", "analyses", "stream-state"))
    fixture(spark, sf_dir, "file_snapshots").write.parquet(source)
    query = snapshots.stream_analyze(snapshots.read_snapshots(spark, source), log, state)
    query.awaitTermination()
    return snapshots.latest_analyses(spark, log).select(
        "path", "last_modified", F.size("analysis.functions").cast("bigint").alias("functions")
    )


def _assemble(files: DataFrame) -> DataFrame:
    a = extract.assemble_analysis(files.select("path", "last_modified", "content"))
    named = F.transform(
        "analysis.functions", lambda f: F.concat(f["name"], F.lit(":"), f["lines_of_code"].cast("string"))
    )
    return a.select(
        "path", "last_modified",
        selection.language(F.col("path")).alias("language"),
        F.array_join("analysis.imports", "|").alias("imports"),
        F.array_join(named, "|").alias("functions"),
        F.array_join("analysis.types", "|").alias("types"),
        F.array_join("analysis.exports", "|").alias("exports"),
    )


def _large_prompts(files: DataFrame) -> DataFrame:
    rows = extract.functions(files, languages=[RUST]).filter(prompts.is_large(F.col("lines_of_code")))
    return prompt_tables.with_prompt(rows).select("path", "ord", "prompt")


def _provider_prompts(files: DataFrame) -> DataFrame:
    rows = prompt_tables.with_prompt(extract.functions(files))
    return rows.select("path", "ord", prompts.provider_prompt(F.col("prompt")).alias("prompt"))


def _extract_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "model_responses").select(
        "conv_id", "turn", prompts.extract_response(F.col("provider"), F.col("body")).alias("answer")
    )


def _inference_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = metrics.inference_metrics(fixture(spark, sf_dir, "inference_log"))
    return rates.withColumn("duration_s", F.round("duration_s", 3)).withColumn(
        "tokens_per_second", F.round("tokens_per_second", 3)
    )


def _call_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.call_metrics(fixture(spark, sf_dir, "inference_log")).select(
        "call_id", "total_tokens", F.round("tokens_per_second", 4).alias("tokens_per_second")
    )


def _summarize(files: DataFrame) -> DataFrame:
    done, _ = summarize.summarize(extract.functions(files), summarize.first_line_summary, "first-line")
    return done.select("path", "ord", "summary")


def _render_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = fixture(spark, sf_dir, "tree_files")
    return report.render_report(
        selection.documentation_files(tree),
        manifests.packages(tree, all_levels=True),
        extract.assemble_analysis(fixture(spark, sf_dir, "code_files")),
    )


def _language_rollup(files: DataFrame) -> DataFrame:
    rolled = rollups.language_rollup(extract.functions(files))
    return rolled.withColumn("avg_loc", F.round("avg_loc", 6)).withColumn("avg_complexity", F.round("avg_complexity", 6))


def _distinct_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = selection.distinct_files(fixture(spark, sf_dir, "file_snapshots"))
    return newest.select("path", "last_modified", F.md5("content").alias("content_md5"))


def _apply_gitignore(tree: DataFrame) -> DataFrame:
    return gitignore.apply_gitignore(tree.select("path"), gitignore.ignore_rules(tree))


def _in_code_directory(tree: DataFrame) -> DataFrame:
    paths = tree.select("path")
    return directories.in_code_directory(paths, directories.code_directories(paths))


def _analysis_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    content = F.when(F.col("broken"), F.concat(text, F.lit(bytearray(b"\xff")))).otherwise(text)
    return errors.analysis_errors(fixture(spark, sf_dir, "bad_files").select("path", content.alias("content"), "io_error"))


def _files_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = fixture(spark, sf_dir, "code_files").select(F.col("path").alias("p"), F.timestamp_seconds("last_modified").alias("at"), F.col("content").alias("body"))
    return tables.files_from_table(table, "p", "at", "body").select("path", "last_modified", F.md5("content").alias("content_md5"))


def _require_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.require_nonempty(fixture(spark, sf_dir, "tree_files"))
    return spark.range(1).select(F.lit(found).alias("nonempty"))


def _read_source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree's files written to a folder that the executors share, then listed and read back."""
    root = scratch_folder(spark, "source-tree").removeprefix("file://").removeprefix("file:")

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                with open(f"{root}/{path}", "wb") as f:
                    f.write(content.encode())
            yield pd.DataFrame({"files": [len(frame)]})

    fixture(spark, sf_dir, "tree_files").select("path", "content").mapInPandas(put, "files long").agg(F.sum("files")).collect()
    return tree.read_source_tree(spark, root).select("rel_path", "length", F.md5("content").alias("content_md5"))


def _analysis_cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base, a delta with removals, a compaction, another delta; then what is stored."""
    folder = scratch_folder(spark, "analysis-cache")
    files = fixture(spark, sf_dir, "code_files")
    ids = files.select("path", "doc_id")
    full = write_through(spark, extract.assemble_analysis(files).select("path", "last_modified", F.lit("x").alias("fingerprint"), "analysis").join(ids, "path"), "analyses")
    entries = lambda where, later: full.where(where).withColumn("last_modified", F.col("last_modified") + F.lit(later).cast("bigint")).drop("doc_id")
    cache.write_analysis_cache(entries("doc_id % 10 <> 0", 0), folder)
    cache.append_analysis_cache(entries("doc_id % 3 = 0", 60), folder, removed=full.where("doc_id % 17 = 0 AND doc_id % 3 <> 0"))
    cache.compact_analysis_cache(spark, folder)
    cache.append_analysis_cache(entries("doc_id % 7 = 0", 120), folder)
    return cache.read_analysis_cache(spark, folder).select("path", "last_modified", F.size("analysis.functions").cast("bigint").alias("functions"))


def _write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixture(spark, sf_dir, "tree_files")
    blocks = report.report_blocks(
        selection.documentation_files(files), manifests.packages(files, all_levels=True), extract.assemble_analysis(fixture(spark, sf_dir, "code_files"))
    )
    target = report_sink.publish_report(blocks, scratch_folder(spark, "report").removeprefix("file://").removeprefix("file:"))
    return report_sink.read_report(spark, target)


def _own_language(files: DataFrame) -> DataFrame:
    names = lambda content: F.regexp_extract_all(content, F.lit(r'(?m)^name = "(.*)"$'), F.lit(1))
    toml = replace(PYTHON, name="toml", suffixes=(".toml",), imports=names)
    return extract.imports(files, languages=(*LANGUAGES, toml))


def queries() -> dict[str, Query]:
    return {
        "files_from_table": _files_from_table,
        "require_nonempty": _require_nonempty,
        "read_source_tree": _read_source_tree,
        "analysis_cache_log": _analysis_cache_log,
        "write_report": _write_report,
        "own_language": _tree(_own_language),
        "line_count": _per_document("lines", text.line_count),
        "token_count": _per_document("tokens", text.token_count),
        "cyclomatic_py": _per_document("complexity", python_source.cyclomatic),
        "cyclomatic_js": _per_document("complexity", javascript_source.cyclomatic),
        "page_braces": _page_braces,
        "language_of": _tree(lambda t: t.select("path", selection.language(F.col("path")).alias("language"))),
        "code_files": _tree(lambda t: selection.code_files(t).select("path")),
        "corpus_file_count": _tree(selection.corpus_file_count),
        "unsupported_files": _tree(lambda t: selection.unsupported_files(t).select("path")),
        "documentation_files": _tree(selection.documentation_files),
        "drop_ignored": _tree(lambda t: selection.drop_ignored(t).select("path")),
        "code_directories": _tree(directories.code_directories),
        "in_code_directory": _tree(_in_code_directory),
        "apply_gitignore": _tree(_apply_gitignore),
        "collect_code_files": _tree(lambda t: analyze.collect_from_table(t).select("path")),
        "distinct_files": _distinct_files,
        "py_imports": _part(PYTHON, "imports", "path", "ord", "import"),
        "py_functions": _part(PYTHON, "functions", *FUNCTION_COLUMNS),
        "py_types": _part(PYTHON, "types", "path", "ord", "type"),
        "py_exports": _code(
            lambda files: files.filter(PYTHON.accepts(F.col("path"))).select(
                "path", F.size(python_source.exports(F.col("content"))).cast("bigint").alias("exports")
            )
        ),
        "py_body": _part(PYTHON, "functions", "path", "ord", "name", "body"),
        "js_imports": _part(JAVASCRIPT, "imports", "path", "ord", "import"),
        "js_functions": _part(JAVASCRIPT, "functions", *FUNCTION_COLUMNS),
        "js_types": _part(JAVASCRIPT, "types", "path", "ord", "type"),
        "js_exports": _part(JAVASCRIPT, "exports", "path", "ord", "export"),
        "js_body": _part(JAVASCRIPT, "functions", "path", "ord", "name", "body"),
        "rust_imports": _part(RUST, "imports", "path", "ord", "import"),
        "rust_types": _part(RUST, "types", "path", "ord", "type"),
        "rust_exports": _part(RUST, "exports", "path", "ord", "export"),
        "rust_functions": _part(RUST, "functions", *FUNCTION_COLUMNS),
        "rust_body": _part(RUST, "functions", "path", "ord", "name", "body"),
        "rust_signature_types": _part(RUST, "functions", "path", "ord", "types"),
        "all_imports": _code(extract.imports),
        "all_functions": _code(lambda files: extract.functions(files).select("language", *FUNCTION_COLUMNS)),
        "all_types": _code(extract.types),
        "all_exports": _code(extract.exports),
        "parameter_count": _code(lambda files: extract.functions(files).select("path", "ord", "parameters")),
        "needs_summary": _code(lambda files: extract.needs_summary(extract.functions(files)).select("path", "ord", "name")),
        "build_prompt": _code(
            lambda files: prompt_tables.with_prompt(extract.functions(files)).select("path", "ord", "prompt")
        ),
        "build_large_prompt": _code(_large_prompts),
        "provider_prompt": _code(_provider_prompts),
        "prompt_parts": _code(lambda files: prompt_tables.prompt_parts(extract.functions(files))),
        "extract_response": _extract_response,
        "npm_packages": _tree(lambda t: manifests.npm_packages(t, all_levels=True)),
        "cargo_packages": _tree(lambda t: manifests.cargo_packages(t, all_levels=True)),
        "last_wins_packages": _tree(lambda t: manifests.packages(t, all_levels=True)),
        "project_name": _tree(manifests.project_names),
        "cache_hits": _cache_hits,
        "cache_misses": _cache_misses,
        "stale_cache": _stale_cache,
        "incremental_analyze": _incremental_analyze,
        "stream_analyze": _stream_analyze,
        "assemble_analysis": _code(_assemble),
        "analysis_errors": _analysis_errors,
        "call_metrics": _call_metrics,
        "inference_metrics": _inference_metrics,
        "summarize": _code(_summarize),
        "render_report": _render_report,
        "language_rollup": _code(_language_rollup),
        "import_usage": _code(lambda files: rollups.import_usage(extract.imports(files))),
        "import_top": _code(lambda files: rollups.import_usage(extract.imports(files), 10)),
        "export_index": _code(lambda files: rollups.export_index(extract.exports(files))),
        "documentation_coverage": _tree(
            lambda t: rollups.documentation_coverage(selection.documentation_files(t), selection.code_files(t))
        ),
    }
