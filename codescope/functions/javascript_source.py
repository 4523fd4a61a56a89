"""Imports, functions, types and exports of JavaScript / TypeScript source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codescope.schema import FUNCTION

from .text import FLAGS, count_of, let, line_count, parameter_count, prefix_sum

# What counts as an import, a function header, a type, an export
# and a branch.
_NAMES = r"(?:\{[^}]*\}|\*\s+as\s+\w+|\w+)"
IMPORT = (
    rf"^(?:import\s+(?:{_NAMES}(?:\s*,\s*{_NAMES})*+\s+from\s+)?['\"](.+?)['\"]"
    r"|(?:const|let|var)\s+(?:\{[^}]*\}|\w+)\s*=\s*require\s*\(\s*['\"](.+?)['\"]\s*\))(?:;|\s*$)"
)
DECLARATION = (
    r"^[^\S\n]*+(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\((.*?)\)(?:\s*:\s*([^{]+))?\s*\{"
)
ARROW = (
    r"^[^\S\n]*+(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?"
    r"\((.*?)\)(?:\s*:\s*([^=]+))?\s*=>"
)
TYPE = r"^[^\S\n]*+(?:export\s+)?(?:type|interface)\s+(\w+)"
EXPORT = r"^export\s+(?:const|let|var|function|class|type|interface)\s+(\w+)"
BRANCH = r"(?U)\b(if|else|for|while|do|switch|case|catch|&&|\|\|)\b"


def imports(content: Column) -> Column:
    def module(m: Column) -> Column:
        es, required = (F.regexp_extract(m, FLAGS + IMPORT, g) for g in (1, 2))
        return F.when(es == "", required).otherwise(es)

    return F.transform(F.regexp_extract_all(content, F.lit(FLAGS + IMPORT), F.lit(0)), module)


def types(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(FLAGS + TYPE), F.lit(1))


def exports(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(FLAGS + EXPORT), F.lit(1))


def cyclomatic(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(BRANCH)) + 1).cast("bigint")


def functions(content: Column, body_mode: str = "reference") -> Column:
    """Array of function structs: all declarations first, then all arrow functions.

    A body runs from the header to the first line end at which the braces opened
    since then are closed again, or to the end of the file. The running brace sum of
    the whole file, sorted by sum and line, gives all these ends at once, so a file
    costs n log n however many functions it has. In ``block`` mode the brace that
    ends a declaration header counts as opened.
    """

    def from_text(unix: Column) -> Column:
        # Splitting leaves one empty string behind a final newline.
        last = F.when(F.endswith(unix, F.lit("\n")), 1).otherwise(0)
        braces = F.split(F.regexp_replace(unix, r"[^{}\n]++", ""), "\n", -1)
        return let(
            F.struct(
                F.split(unix, "\n", -1).alias("lines"),
                prefix_sum(F.transform(braces, _net)).alias("depth"),
                last.alias("last"),
            ),
            lambda t: F.concat(
                _pass(content, DECLARATION, "{", t, 1 if body_mode == "block" else 0),
                _pass(content, ARROW, "=>", t, 0),
            ),
        )

    return F.when(
        F.contains(content, F.lit("function")) | F.contains(content, F.lit("=>")),
        let(F.replace(content, F.lit("\r\n"), F.lit("\n")), from_text),
    ).otherwise(F.array())


def _braces(text: Column) -> Column:
    return count_of(text, "{") - count_of(text, "}")


def _net(braces: Column) -> Column:
    """Opening minus closing, in a text of braces only."""
    return F.length(F.replace(braces, F.lit("}"), F.lit(""))) * 2 - F.length(braces)


def _next_at_depth(depth: Column, asked: Column) -> Column:
    """For each of ``asked`` (left, row) the first later row where ``depth`` is ``left``, or null.

    Rows and questions are sorted together: a question with ``i`` entries before it, ``m`` of
    them questions, stands right before the row in place ``i - m`` of the sorted rows.
    """
    entry = lambda d, row, j: F.struct(d.cast("int").alias("d"), row.cast("int").alias("row"), j.cast("int").alias("j"))
    rows = F.transform(depth, lambda d, i: entry(d, i, F.lit(-1)))
    questions = F.transform(asked, lambda q, j: entry(q["left"], q["row"], j))

    def place(merged: Column) -> Column:
        places = F.transform(merged, lambda e, i: F.when(e["j"] >= 0, F.struct(e["j"].alias("j"), e["d"].alias("d"), i.alias("i"))))
        found = let(
            F.filter(merged, lambda e: e["j"] < 0),
            lambda own: F.transform(
                F.filter(places, lambda q: q.isNotNull()),
                lambda q, m: let(
                    F.get(own, q["i"] - m),
                    lambda e: F.struct(q["j"].alias("j"), F.when(e["d"] == q["d"], e["row"]).alias("row")),
                ),
            ),
        )
        return F.transform(F.array_sort(found), lambda x: x["row"])

    return let(F.array_sort(F.concat(rows, questions)), place)


def _pass(content: Column, header: str, end: str, text: Column, opened: int) -> Column:
    """Functions of one kind of header. ``end`` is what every header ends with."""
    lines, depth = text["lines"], text["depth"]
    # Headers and the stretches between them, in turn: a header starts a line and ends
    # inside one, so no two headers meet, and the first piece tells which comes first.
    # Behind the last ``end`` there is no header: a return type that looks for one in
    # vain would read on to the end of the file, once for each line.
    pattern = rf"{FLAGS}{header}|(?:(?!{header})[^\n]*+(?:\n|\z))++"
    tail = F.when(F.contains(content, F.lit(end)), F.substring_index(content, end, -1)).otherwise(content)

    def locate(ps: Column, tail: Column) -> Column:
        offset = F.when(F.get(ps, F.lit(0)).rlike(rf"(?dU)\A{header}"), 0).otherwise(1)
        return let(
            F.struct(offset.alias("offset"), prefix_sum(F.transform(ps, lambda p: count_of(p, "\n"))).alias("rows")),
            lambda at: F.filter(
                F.transform(
                    ps,
                    lambda p, i: F.when(
                        (i % 2 == at["offset"]) & (p != ""),
                        F.struct(
                            p.alias("header"),
                            F.get(at["rows"], i).alias("row"),
                            F.concat(
                                F.coalesce(F.get(ps, i + 1), F.lit("")),
                                F.when(i + 2 < F.size(ps), F.lit("")).otherwise(tail),
                            ).alias("rest"),
                        ),
                    ),
                ),
                lambda f: f.isNotNull(),
            ),
        )

    def with_line(f: Column) -> Column:
        # What is left of the header's own line; the next header starts on a later one.
        first = F.regexp_extract(f["rest"], r"(?d)\A(.*?)(?:\r?\n|\z)", 1)

        def asked(line: Column) -> Column:
            opens = _braces(line) + opened
            return F.struct(
                f["header"].alias("header"),
                f["row"].alias("row"),
                line.alias("line"),
                (f["rest"] == "").alias("ends"),
                opens.alias("opens"),
                (F.get(depth, f["row"]) - opens).alias("left"),
            )

        return let(first, asked)

    def with_body(fs: Column) -> Column:
        rows = F.slice(depth, F.lit(1), F.size(depth) - text["last"])

        def cut(f: Column, closed: Column) -> Column:
            to = F.when(f["opens"] == 0, f["row"]).otherwise(F.coalesce(closed, F.greatest(F.size(lines) - text["last"] - 1, f["row"])))
            taken_lines = F.concat(F.array(f["line"]), F.slice(lines, f["row"] + 2, to - f["row"]))
            # Nothing at all follows the header: no line, so no newline either.
            body = F.when(f["ends"], F.lit("")).otherwise(F.concat(F.array_join(taken_lines, "\n"), F.lit("\n")))
            return F.struct(f["header"].alias("header"), body.alias("body"))

        # One row per line and one per function: without functions there is nothing to sort.
        found = let(_next_at_depth(rows, fs), lambda closed: F.transform(fs, lambda f, j: cut(f, F.get(closed, j))))
        return F.when(F.size(fs) > 0, found)

    def groups(f: Column) -> Column:
        parts = [F.regexp_extract(f["header"], FLAGS + header, g) for g in (1, 2, 3)]
        return F.struct(*[p.alias(n) for p, n in zip(parts, "npr")], f["body"].alias("body"))

    def measure(f: Column) -> Column:
        name, params, returned = f["n"], f["p"], f["r"]
        colon = F.when(returned == "", F.lit("")).otherwise(F.concat(F.lit(": "), returned))
        return F.struct(
            name.alias("name"),
            F.concat(F.lit("const "), name, F.lit(" = ("), params, F.lit(")"), colon, F.lit("=> ")).alias("signature"),
            F.lit("").alias("types"),
            f["body"].alias("body"),
            line_count(f["body"]).alias("lines_of_code"),
            cyclomatic(f["body"]).alias("cyclomatic_complexity"),
            parameter_count(params).alias("parameters"),
            (returned != "").alias("returns"),
            F.lit(None).cast("string").alias("summary"),
        )

    def headers(tail: Column) -> Column:
        head = F.left(content, F.length(content) - F.length(tail))
        return let(F.regexp_extract_all(head, F.lit(pattern), F.lit(0)), lambda ps: F.transform(locate(ps, tail), with_line))

    found = F.transform(F.transform(let(let(tail, headers), with_body), groups), measure)
    return F.coalesce(found, F.array().cast(f"array<{FUNCTION}>"))
