"""Report sections as tables to query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import top_directory_of


def language_rollup(functions: DataFrame) -> DataFrame:
    """Per language and (language null) in total.

    Grouped by file first, so the distinct count of files is a plain count of the
    pre-aggregated rows, and a language with a third of all rows costs no more.
    """
    by_file = functions.groupBy("language", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("lines_of_code").alias("loc"),
        F.max("lines_of_code").alias("loc_max"),
        F.sum("cyclomatic_complexity").alias("cc"),
        F.max("cyclomatic_complexity").alias("cc_max"),
    )
    return (
        by_file.rollup("language")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("n").alias("functions"),
            F.sum("loc").alias("sum_loc"),
            F.max("loc_max").alias("max_loc"),
            F.sum("cc").alias("sum_complexity"),
            F.max("cc_max").alias("max_complexity"),
        )
        .withColumn("avg_loc", F.col("sum_loc") / F.col("functions"))
        .withColumn("avg_complexity", F.col("sum_complexity") / F.col("functions"))
    )


def import_usage(imports: DataFrame, k: int | None = None) -> DataFrame:
    """Files and uses per imported module, most used first if ``k`` is given."""
    usage = (
        imports.groupBy("import", "path")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("import")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("uses"))
    )
    return usage if k is None else usage.orderBy(F.desc("files"), "import").limit(k)


def export_index(exports: DataFrame) -> DataFrame:
    """One row per exported symbol and file, with the number of files that export it.

    Rows rather than a list per symbol: a popular symbol has no bound. The join back
    to the per-symbol counts is left to the adaptive planner to split.
    """
    where = exports.select("export", "path").distinct()
    # Counted from the same distinct rows, whose shuffle Spark then runs once.
    counts = where.groupBy("export").agg(F.count(F.lit(1)).alias("files"))
    return where.join(counts, "export").withColumn("duplicated", F.col("files") > 1)


def documentation_coverage(docs: DataFrame, code: DataFrame) -> DataFrame:
    """Documentation and code files per top directory, from one grouping."""
    both = docs.select("path", F.lit(1).alias("doc")).unionByName(code.select("path", F.lit(0).alias("doc")))
    return both.groupBy(top_directory_of(F.col("path")).alias("directory")).agg(
        F.sum("doc").alias("docs"), F.sum(1 - F.col("doc")).alias("code_files")
    )
