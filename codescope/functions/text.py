"""Text primitives shared by every extractor, as plain column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex flags used by all patterns: only "\n" ends a line (d), "^"/"$" work
# per line (m), and \w \s \b follow Unicode (U).
FLAGS = "(?mdU)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression, so ``body`` may use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a one-character string."""
    return F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))


def line_count(text: Column) -> Column:
    """Number of lines; a final newline does not open another line."""
    return (
        F.when(text == "", 0)
        .otherwise(count_of(text, "\n") + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))
        .cast("bigint")
    )


def token_count(text: Column) -> Column:
    """Whitespace-separated tokens (Unicode white space)."""
    return F.regexp_count(text, F.lit(r"(?U)\S++")).cast("bigint")


def lines_of(text: Column) -> Column:
    """Lines of a text, "\\r\\n" counted as one line end, no trailing empty line."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    body = F.when(F.endswith(unix, F.lit("\n")), F.substr(unix, F.lit(1), F.length(unix) - 1)).otherwise(unix)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def parameter_count(params: Column) -> Column:
    """Comma pieces that hold something other than white space."""
    return F.regexp_count(params, F.lit(r"(?U)[^,\s][^,]*+")).cast("bigint")


def prefix_sum(values: Column) -> Column:
    """Inclusive running sum of an integer array, inside the row.

    Spark has no array scan, and a fold that appends to its accumulator copies it at
    every step. This doubles the stride on each pass instead: log2(n) passes, so
    O(n log n) for a file of n lines, with no explode, shuffle or Python.
    """

    def scan(v: Column) -> Column:
        strides = F.when(
            F.size(v) > 1,
            F.transform(
                F.sequence(F.lit(0), F.length(F.bin((F.size(v) - 1).cast("bigint"))) - 1),
                lambda k: F.pow(F.lit(2), k).cast("int"),
            ),
        ).otherwise(F.array().cast("array<int>"))
        return F.aggregate(
            strides,
            v,
            lambda acc, d: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - d), F.lit(0))),
        )

    return let(values.cast("array<int>"), scan)
