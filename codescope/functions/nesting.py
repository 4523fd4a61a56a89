"""Rust comments and attribute brackets of any nesting depth, made flat for patterns that count to a fixed one.

A regular expression cannot count, so the patterns of ``rust_source`` write out a fixed number of levels. Here a
text that goes beyond them is cut into pieces that no lexical state splits, and a fold over the pieces, with a small
state, finds the stretches that are too deep. Inside these the delimiters give way to stand-ins (noncharacters,
which no text should hold); ``with_brackets`` and ``with_comments`` put them back into whatever is printed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Stand-ins for "/*", "*/", "[" and "]".
_OPEN, _CLOSE, _LEFT, _RIGHT = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"

_LITERAL = r"'(?:[^'\\\n]|\\(?:x\p{XDigit}{2}|u\{[^}]*+\}|.))'"
_PIECE = (
    rf"""(?dU)(?:(?:[^/*"'\\\nr]++|r(?!#*+")|/(?![/*])|\*(?!/))++|/\*|\*/|//\*|//|\\['\\]|\\"#*+|r#*+"#*+|"#*+|{_LITERAL}|(?s:.))"""
)
# States of the fold: code, string, raw string, line comment, block comment.
_CODE, _STRING, _RAW, _LINE, _BLOCK = range(5)


def _too_deep(events: Column, pair: str, levels: int) -> Column:
    """Whether something is left of the events once ``levels`` rounds have taken out every innermost pair."""
    for _ in range(levels):
        events = F.replace(events, F.lit(pair), F.lit(""))
    return F.contains(events, F.lit(pair[0]))


def _split_at(pieces: Column, found: Column, inside: Column) -> Column:
    """The pieces joined again, those of each stretch (first, last), but its ends, changed by ``inside``."""
    before = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(found, j - 1)["last"] + 1)
    parts = F.transform(
        found,
        lambda f, j: F.concat(
            F.slice(pieces, before(j) + 1, f["first"] + 1 - before(j)),
            F.transform(F.slice(pieces, f["first"] + 2, f["last"] - f["first"] - 1), inside),
            F.slice(pieces, f["last"] + 1, F.lit(1)),
        ),
    )
    rest = F.get(found, F.size(found) - 1)["last"] + 2
    return F.concat(F.array_join(F.flatten(parts), ""), F.array_join(F.slice(pieces, rest, F.size(pieces)), ""))


def _deep_comments(pieces: Column, levels: int) -> Column:
    """Stretches (first, last) of pieces: block comments that nest deeper than ``levels``."""
    stretches = "array<struct<first:int,last:int>>"
    start = F.struct(
        F.lit(0).alias("at"), F.lit(_CODE).alias("mode"), F.lit(0).alias("k"), F.lit(0).alias("first"), F.lit(0).alias("top"),
        F.array().cast(stretches).alias("found"),
    )

    def step(s: Column, p: Column) -> Column:
        mode, k = s["mode"], s["k"]
        code, block = mode == _CODE, mode == _BLOCK
        hashes = F.length(F.regexp_extract(p, r'"(#*)\z', 1))
        quote = F.contains(p, F.lit('"'))
        opened = quote & ~F.startswith(p, F.lit("'"))
        opens, closes = F.endswith(p, F.lit("/*")), p == "*/"
        deeper = F.when(block & opens, k + 1).when(block & closes, k - 1)
        over = block & (deeper == 0)
        entered = code & (p == "/*")
        next_mode = (
            F.when(entered, _BLOCK)
            .when(code & F.startswith(p, F.lit("//")), _LINE)
            .when(code & opened & F.startswith(p, F.lit("r")), _RAW)
            .when(code & opened, _STRING)
            .when(over, _CODE)
            .when((mode == _STRING) & quote & ~F.contains(p, F.lit('\\"')), _CODE)
            .when((mode == _RAW) & quote & (hashes >= k), _CODE)
            .when((mode == _LINE) & (p == "\n"), _CODE)
            .otherwise(mode)
        )
        raw = F.length(F.regexp_extract(p, r'\Ar(#*)"', 1))
        next_k = F.when(entered, 1).when(code & opened, raw).when(block, F.coalesce(deeper, k)).otherwise(k)
        top = F.when(entered, 1).otherwise(F.greatest(s["top"], F.when(block, F.coalesce(deeper, F.lit(0))).otherwise(0)))
        kept = over & (s["top"] > levels)
        here = F.array(F.struct(s["first"].alias("first"), s["at"].alias("last")))
        return F.struct(
            (s["at"] + 1).alias("at"),
            next_mode.alias("mode"),
            next_k.cast("int").alias("k"),
            F.when(entered, s["at"]).otherwise(s["first"]).alias("first"),
            top.cast("int").alias("top"),
            F.when(kept, F.concat(s["found"], here)).otherwise(s["found"]).cast(stretches).alias("found"),
        )

    return F.aggregate(pieces, start, step, lambda s: s["found"])


def _flat_comments(content: Column, levels: int) -> Column:
    def inside(p: Column) -> Column:
        return F.replace(F.replace(p, F.lit("/*"), F.lit(_OPEN)), F.lit("*/"), F.lit(_CLOSE))

    def flat(pieces: Column) -> Column:
        return let(_deep_comments(pieces, levels), lambda found: F.when(F.size(found) > 0, _split_at(pieces, found, inside)))

    return F.coalesce(let(F.regexp_extract_all(content, F.lit(_PIECE), F.lit(0)), flat), content)


def _flat_attributes(content: Column, pieces: Column, levels: int) -> Column:
    """Attributes whose brackets nest deeper than ``levels``; ``pieces`` keep literals and comments whole."""
    stretches = "array<struct<first:int,last:int>>"
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(0).alias("first"), F.lit(0).alias("top"), F.lit(False).alias("mark"),
        F.array().cast(stretches).alias("found"),
    )

    def step(s: Column, p: Column) -> Column:
        entered = (s["k"] == 0) & s["mark"] & (p == "[")
        k = F.when(entered, 1).when((s["k"] > 0) & (p == "["), s["k"] + 1).when((s["k"] > 0) & (p == "]"), s["k"] - 1).otherwise(s["k"])
        top = F.when(entered, 1).otherwise(F.greatest(s["top"], k))
        kept = (s["k"] == 1) & (k == 0) & (top >= levels)  # a piece may hold one level of its own
        here = F.array(F.struct(s["first"].alias("first"), s["at"].alias("last")))
        return F.struct(
            (s["at"] + 1).alias("at"),
            k.cast("int").alias("k"),
            F.when(entered, s["at"]).otherwise(s["first"]).alias("first"),
            top.cast("int").alias("top"),
            p.rlike(r"(?dU)#!?\s*+\z").alias("mark"),
            F.when(kept, F.concat(s["found"], here)).otherwise(s["found"]).cast(stretches).alias("found"),
        )

    def inside(p: Column) -> Column:
        return F.when(p == "[", F.lit(_LEFT)).when(p == "]", F.lit(_RIGHT)).otherwise(p)

    found = F.aggregate(pieces, start, step, lambda s: s["found"])
    return F.coalesce(let(found, lambda f: F.when(F.size(f) > 0, _split_at(pieces, f, inside))), content)


def flat(content: Column, pieces_of, levels: int) -> Column:
    """The text with nested comments and attributes made flat where they go deeper than ``levels``.

    Most texts never come near it: their delimiters alone, taken out pair by pair, are soon gone.
    """
    marks = F.transform(F.regexp_extract_all(content, F.lit(r"/\*|\*/"), F.lit(0)), lambda m: F.left(m, F.lit(1)))
    deep = (F.regexp_count(content, F.lit(r"/\*")) > levels) & _too_deep(F.array_join(marks, ""), "/*", levels)
    commented = F.when(deep, _flat_comments(content, levels)).otherwise(content)

    def attributes(c: Column) -> Column:
        many = (F.regexp_count(c, F.lit(r"\[")) > levels) & c.rlike(r"(?dU)#!?\s*+\[")
        nested = many & _too_deep(F.regexp_replace(c, r"[^\[\]]++", ""), "[]", levels - 1)
        return F.when(nested, let(pieces_of(c), lambda ps: _flat_attributes(c, ps, levels))).otherwise(c)

    return let(commented, attributes)


def with_brackets(text: Column) -> Column:
    """The brackets that ``flat`` replaced, put back."""
    return F.replace(F.replace(text, F.lit(_LEFT), F.lit("[")), F.lit(_RIGHT), F.lit("]"))


def with_comments(text: Column) -> Column:
    """The comment delimiters that ``flat`` replaced, put back."""
    return F.replace(F.replace(text, F.lit(_OPEN), F.lit("/*")), F.lit(_CLOSE), F.lit("*/"))
