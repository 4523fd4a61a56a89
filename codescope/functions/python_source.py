"""Imports, functions and classes of Python source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FLAGS, let, line_count, parameter_count

# What counts as an import, a function header, a class and a branch.
IMPORT = r"^(?:from\s+(\S+)\s+)?import\s+(.+)$"
DEF = r"def\s+(\w+)\s*\((.*?)\)(?:\s*->\s*([^:]+))?\s*:"
CLASS = r"^[^\S\n]*+class\s+(\w+)"
BRANCH = r"(?U)\b(if|elif|for|while|except|and|or)\b"

_BLANK_LINES = r"(?:[^\S\n]*+\n)*+"
_LINE_END = r"(?:\n|\z)"

# One match per header. The lookahead captures header and body as group 1 without
# consuming the body, so nested functions are still found; group 2 is the
# indentation. Any other line is skipped whole (group 1 stays empty), which keeps
# the search linear on long runs of blank lines.
_WITH_BODY = {
    # Indentation may reach back over blank lines; the body then ends at the first
    # line that is blank or does not start with it.
    "reference": (
        rf"{FLAGS}^(?:(?=((\s*+){DEF}{_BLANK_LINES}"
        rf"(?:(?![^\S\n]*+{_LINE_END})\2[^\n]*+{_LINE_END})*+))\s*+{DEF}|\s*+[^\n]*+)"
    ),
    # The lines below the header that are blank or indented deeper than it.
    "block": (
        rf"{FLAGS}^(?:(?=(([ \t]*+){DEF}[^\n]*+{_LINE_END}"
        rf"(?:[^\S\n]*+\n|\2[ \t]++\S[^\n]*+{_LINE_END})*+))[ \t]*+{DEF}|[^\n]*+)"
    ),
}
_HEADER = r"(?dU)\A\s*+" + DEF


def imports(content: Column) -> Column:
    def render(m: Column) -> Column:
        module = F.regexp_extract(m, FLAGS + IMPORT, 1)
        names = F.regexp_extract(m, FLAGS + IMPORT, 2)
        return F.when(module == "", names).otherwise(F.concat(names, F.lit(" from "), module))

    return F.transform(F.regexp_extract_all(content, F.lit(FLAGS + IMPORT), F.lit(0)), render)


def types(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(FLAGS + CLASS), F.lit(1))


def exports(content: Column) -> Column:
    """Python has no export statement: always empty."""
    return F.array().cast("array<string>")


def cyclomatic(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(BRANCH)) + 1).cast("bigint")


def functions(content: Column, body_mode: str = "reference") -> Column:
    """Array of function structs in source order."""
    blocks = F.array_remove(
        F.regexp_extract_all(content, F.lit(_WITH_BODY[body_mode]), F.lit(1)), F.lit("")
    )

    def split(block: Column) -> Column:
        header = F.regexp_extract(block, _HEADER, 0)
        return let(
            header,
            lambda h: F.struct(h.alias("header"), _body(F.substr(block, F.length(h) + 1)).alias("body")),
        )

    def measure(f: Column) -> Column:
        name, params, returned = (F.regexp_extract(f["header"], _HEADER, g) for g in (1, 2, 3))
        arrow = F.when(returned == "", F.lit("")).otherwise(F.concat(F.lit(" -> "), returned))
        return F.struct(
            name.alias("name"),
            F.concat(F.lit("def "), name, F.lit("("), params, F.lit(")"), arrow, F.lit(":")).alias("signature"),
            returned.alias("types"),
            f["body"].alias("body"),
            line_count(f["body"]).alias("lines_of_code"),
            cyclomatic(f["body"]).alias("cyclomatic_complexity"),
            parameter_count(params).alias("parameters"),
            (returned != "").alias("returns"),
            F.lit(None).cast("string").alias("summary"),
        )

    return F.transform(F.transform(blocks, split), measure)


def _body(raw: Column) -> Column:
    """Drop blank lines around the body and join its lines with a plain newline."""
    text = F.regexp_extract(raw, rf"(?sU)\A{_BLANK_LINES}(.*\S(?:(?!\r\n)[^\S\n])*+)", 1)
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))
