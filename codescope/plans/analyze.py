"""Whole runs: which files, what changed, analysis, summaries, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import name_of
from ..operators import cache as C
from ..operators import report as R
from ..operators.directories import CODE_IDENTIFIERS, code_directories, in_code_directory
from ..operators.errors import BAD_TEXT, with_errors
from ..operators.extract import analysis, explode_analysis
from ..operators.gitignore import RULE_FILES, ignore_rules, unignored_paths
from ..operators.languages import LANGUAGES, LanguageExtractor
from ..operators.selection import code_files, distinct_files, documentation_files, drop_ignored
from ..operators.summarize import Summarizer, summarize
from ..schema import CACHE
from ..scratch import write_through
from ..sources.manifests import packages
from ..sources.tables import text_content
from ..sources.tree import list_source_tree, read_contents, rules_above


def collect_code_files(
    files: DataFrame,
    rule_files: DataFrame | None = None,
    custom_ignore: Sequence[str] = (),
    identifiers: Sequence[str] = CODE_IDENTIFIERS,
    root: str = "",
    languages: Sequence[LanguageExtractor] = LANGUAGES,
) -> DataFrame:
    """Code files to analyse: in a code directory, not ignored, of a known extension.

    ``files`` needs no content; ``rule_files`` are the ignore files with theirs. The
    cheap row filters come first, so the walk along the paths sees code files only.
    Code directories are written once, as the walk reads them twice.
    """
    spark = files.sparkSession
    dirs = write_through(spark, code_directories(files, identifiers, custom_ignore, root), "code-directories")
    wanted = code_files(drop_ignored(files, custom_ignore, root), languages)
    if rule_files is None:
        return in_code_directory(wanted, dirs)
    kept = unignored_paths(wanted.select("path").distinct(), ignore_rules(rule_files), dirs, inside=True)
    return wanted.join(kept, "path", "left_semi").select(*wanted.columns)


def collect_from_table(files: DataFrame, **options) -> DataFrame:
    """``collect_code_files`` for a table with contents.

    Paths are chosen on the key columns, listed once; contents are read once and join
    the chosen paths, without a shuffle where the table is bucketed by path.
    """
    keys = write_through(files.sparkSession, files.select("path", "last_modified"), "listing")
    rules = files.filter(name_of(F.col("path")).isin(*RULE_FILES))
    chosen = collect_code_files(keys, rules, **options).select("path")
    return code_files(files, options.get("languages", LANGUAGES)).join(chosen, "path", "left_semi")


@dataclass
class Run:
    """Result of one run; every table is lazy but what had to be written.

    ``errors`` lists the files that could not be analysed (path, kind, message).
    """

    analyses: DataFrame
    documentation: DataFrame
    packages: DataFrame
    log: DataFrame | None = None
    errors: DataFrame | None = None

    def report(self) -> DataFrame:
        return R.report_blocks(self.documentation, self.packages, self.analyses)


def analyze_tree(
    spark: SparkSession,
    root: str,
    cache_path: str | None = None,
    summarizer: Summarizer | None = None,
    model: str = "",
    custom_ignore: Sequence[str] = (),
    on_error: str = "fail",
    body_mode: str = "reference",
    languages: Sequence[LanguageExtractor] = LANGUAGES,
    answers_path: str | None = None,
) -> Run | None:
    """Analyse a source tree; None if it has no code files.

    The tree is listed once. Unchanged files are found on listed paths and times, so
    only changed files are ever read. What later steps read more than once (listing,
    chosen paths, fresh analyses) is written first.

    Rule files in the directories above the root count as well. A file that cannot be read or analysed, a rule file or
    manifest that is no text included, is an error row. All good files are analysed, summarised and
    cached before a run with ``on_error="fail"`` raises; ``"quarantine"`` returns with the rows in
    ``errors``. The cache is keyed by path, time and a fingerprint of model, body mode and
    languages, and a result never holds an entry of another key.
    """
    root = root.rstrip("/") or "/"
    listing = write_through(spark, list_source_tree(spark, root), "listing")
    found = read_contents(listing.filter(F.col("name").isin(*RULE_FILES))).select("path", "content", "io_error")
    rules, bad_rules = _as_text(spark, found.unionByName(rules_above(spark, root, RULE_FILES)), "rules")
    chosen = write_through(
        spark, distinct_files(collect_code_files(listing, rules, custom_ignore, root=root, languages=languages)), "chosen"
    )
    if chosen.select("path").isEmpty():
        return None
    named = listing.filter(F.col("rel_path").isin("package.json", "Cargo.toml"))
    manifests, bad_manifests = _as_text(spark, read_contents(named).select("path", "content", "io_error"), "manifests")

    asked = model if summarizer is not None else None
    fingerprint = F.lit(repr((asked, body_mode, [lang.name for lang in languages])))
    chosen = chosen.withColumn("fingerprint", fingerprint)
    cache = C.read_analysis_cache(spark, cache_path) if cache_path else spark.createDataFrame([], CACHE)
    columns = ["path", "last_modified", "fingerprint", "analysis"]
    hits = C.cache_hits(chosen, cache).select(columns)
    changed = with_errors(read_contents(C.cache_misses(chosen, cache)), languages)
    found = F.when(F.col("error").isNull(), analysis(body_mode=body_mode, languages=languages))
    tried = write_through(spark, changed.select("path", "last_modified", "fingerprint", found.alias("analysis"), "error"), "fresh")
    errors = tried.filter("error IS NOT NULL").select("path", "error.*").unionByName(bad_rules).unionByName(bad_manifests)
    fresh = tried.filter("error IS NULL").select(columns)
    log = None
    if summarizer is not None:
        fresh, log = with_summaries(fresh, summarizer, model, languages, answers_path)
        fresh = write_through(spark, fresh, "summarised")
    analyses = fresh.unionByName(hits)
    if cache_path:
        C.append_analysis_cache(C.next_cache(fresh, cache, evict=True, languages=languages), cache_path)
    if on_error == "fail" and (first := errors.orderBy("path").head(1)):
        raise ValueError(": ".join(first[0]))
    return Run(analyses, documentation_files(listing), packages(manifests, root), log, errors)


def _as_text(spark: SparkSession, files: DataFrame, purpose: str) -> tuple[DataFrame, DataFrame]:
    """Rule files or manifests as text, and (path, kind, message) of those that cannot be read or are not text."""
    read = write_through(spark, text_content(files), purpose)
    message = F.coalesce("io_error", F.lit(BAD_TEXT)).alias("message")
    return read.filter("content IS NOT NULL").drop("io_error"), read.filter("content IS NULL").select("path", F.lit("IoError").alias("kind"), message)


def with_summaries(
    analyses: DataFrame,
    summarizer: Summarizer,
    model: str = "",
    languages: Sequence[LanguageExtractor] = LANGUAGES,
    answers_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Analyses with summaries filled in, and the log of calls; answers come from and go to the store at ``answers_path``.

    Only the summaries travel: they are grouped by file and set into the function
    list of the stored row. A file's functions are bounded by the file.
    """
    rows = explode_analysis(analyses, "functions", languages)
    done, log = summarize(rows, summarizer, model, languages=languages, store=answers_path)
    answers = (
        done.filter("summary IS NOT NULL")
        .groupBy("path")
        .agg(F.map_from_entries(F.collect_list(F.struct("ord", "summary"))).alias("answers"))
    )
    filled = F.transform(
        F.col("analysis.functions"),
        lambda f, i: f.withField("summary", F.try_element_at("answers", (i + 1).cast("bigint"))),
    )
    kept = [c for c in analyses.columns if c != "analysis"]
    joined = analyses.join(answers, "path", "left")
    return joined.select(*kept, F.col("analysis").withField("functions", filled).alias("analysis")), log
