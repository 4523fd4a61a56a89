"""Markdown report as ordered lines; it becomes text only when it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Report headings and labels.
TITLE = "# Code Summary"
DOCUMENTATION = "## Documentation Files"
PACKAGES = "## Package Information"
CODE = "## Code Analysis"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _list_section(title: str, values: Column, line) -> Column:
    """Title, one line per value and a blank line; nothing for an empty list."""
    lines = F.array_join(F.transform(values, line), "")
    return F.when(F.size(values) > 0, _text(f"**{title}:**\n", lines, "\n")).otherwise(F.lit(""))


def _function(f: Column) -> Column:
    summary = F.when(f["summary"].isNotNull(), _text("  Summary: ", f["summary"], "\n")).otherwise(F.lit(""))
    return _text(
        "- ", f["name"], "\n  Signature: ", f["signature"],
        "\n  Lines of code: ", f["lines_of_code"].cast("string"),
        "\n  Cyclomatic complexity: ", f["cyclomatic_complexity"].cast("string"),
        "\n  Parameters: ", f["parameters"].cast("string"),
        "\n  Returns: ", f["returns"].cast("string"), "\n", summary, "\n",
    )


def file_block(path: Column, analysis: Column) -> Column:
    """Report text of one file."""
    functions, types = analysis["functions"], analysis["types"]
    function_text = F.array_join(F.transform(functions, _function), "")
    # The fence is tagged "rust" whatever the language.
    type_text = F.array_join(F.transform(types, lambda t: _text("```rust\n", t, "\n```\n\n")), "")
    return _text(
        "## ", path, "\n\n",
        _list_section("Imports", analysis["imports"], lambda v: _text("- ", v, "\n")),
        F.when(F.size(functions) > 0, _text("**Functions:**\n", function_text)).otherwise(F.lit("")),
        F.when(F.size(types) > 0, _text("**Types:**\n", type_text)).otherwise(F.lit("")),
        _list_section("Exports", analysis["exports"], lambda v: _text("- ", v, "\n")),
        "\n\n",
    )


def report_blocks(docs: DataFrame, packages: DataFrame, analyses: DataFrame) -> DataFrame:
    """section_ord, path, text: a few lines of text per row, each ending with a newline.

    ``analyses`` has an analysis in every row. There is no filter on it here: pushed
    below the projection it would run the extraction twice.
    """
    spark = analyses.sparkSession
    headings = spark.createDataFrame(
        [
            (0, "", f"{TITLE}\n\n"),
            (1, "", f"{DOCUMENTATION}\n"),
            (3, "", f"\n{PACKAGES}\n"),
            (5, "", f"\n{CODE}\n"),
        ],
        "section_ord int, path string, text string",
    )
    doc_rows = docs.select(F.lit(2).alias("section_ord"), "path", _text("- ", F.col("path"), "\n").alias("text"))
    package_rows = packages.select(
        F.lit(4).alias("section_ord"),
        F.col("name").alias("path"),
        _text("- ", F.col("name"), ": ", F.col("version"), "\n").alias("text"),
    )
    file_rows = analyses.select(
        F.lit(6).alias("section_ord"), "path", file_block(F.col("path"), F.col("analysis")).alias("text")
    )
    return headings.unionByName(doc_rows).unionByName(package_rows).unionByName(file_rows)


def render_report(docs: DataFrame, packages: DataFrame, analyses: DataFrame) -> DataFrame:
    """section_ord, path, ord, line. Sort by the first three for the report's order."""
    lines = report_blocks(docs, packages, analyses).select(
        "section_ord",
        "path",
        F.posexplode_outer(F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1)).alias("ord", "line"),
    )
    return lines.withColumn("ord", F.col("ord").cast("bigint"))


def report_name(project: str, date: str, name_format: str | None = None) -> str:
    """``{folder}`` and ``{date}`` filled in; ``summary-{folder}-{date}.md`` by default."""
    return (name_format or "summary-{folder}-{date}.md").replace("{folder}", project).replace("{date}", date)


def write_report(blocks: DataFrame, out_dir: str, project: str, date: str, name_format: str | None = None) -> str:
    """Write the report as text files in order below one folder of the report's name.

    Sorted by ranges, so every task writes its own stretch: the part files, taken by
    name, are the report. No task holds more than its range. Blocks are sorted, not
    single lines, as they are far fewer.
    """
    target = f"{out_dir.rstrip('/')}/{report_name(project, date, name_format)}"
    # The text sink ends each row with a newline of its own.
    text = F.regexp_replace("text", r"\n\z", "").alias("value")
    blocks.orderBy("section_ord", "path").select(text).write.mode("overwrite").text(target)
    return target
