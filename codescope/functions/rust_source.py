"""Imports, functions, types and exports of Rust source text.

Works on lexical structure, not on a syntax tree: the text is cut into pieces so
that comments, strings and characters are opaque, a running bracket depth finds the
top-level items, and each item is read from its own short text. Comments and attribute
brackets that nest deeper than the patterns count are made flat first (``nesting``). Known
limits: "||" of an argument-less closure (printed as one token), and "<<" / ">>" told apart
from generics by the blanks around them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nesting import flat, with_brackets, with_comments
from .text import count_of, let, prefix_sum

# --- lexical patterns -------------------------------------------------------------


def _nested_comment(depth: int) -> str:
    inner = "" if depth == 0 else "|" + _nested_comment(depth - 1)
    return rf"/\*(?:[^*/]++|\*(?!/)|/(?!\*){inner})*+\*/"


# A pattern cannot call itself: each level of nesting is written out.
_LEVELS = 16
_COMMENT = rf"(?://[^\n]*+|{_nested_comment(_LEVELS - 1)})"
_DOC = rf"(?:(?=///(?!/)|//!|/\*\*(?![*/])|/\*!){_COMMENT})"
_STRING = r'"(?:[^"\\]++|\\(?s:.))*+"'


def _opaque(group: str) -> str:
    """Comment, string, character or lifetime; ``group`` names the raw string's hashes."""
    return (
        rf'(?:{_COMMENT}|(?:b|c)?r(?<{group}>#*+)"(?s:.*?)"\k<{group}>|[bc]?{_STRING}'
        r"|b?'(?:[^'\\\n]|\\(?:x\p{XDigit}{2}|u\{[^}]*+\}|.))'|'\w++)"
    )


_OPAQUE = _opaque("h")
_PLAIN = r"""[^{}()\[\];"'/rbc]++|[rbc](?!r?#*+["'])"""
# A stretch with no brackets, or with brackets that open and close inside it.
_RUN = (
    rf"(?:{_opaque('h')}|{_PLAIN}"
    rf"|\((?:{_opaque('i')}|{_PLAIN})*+\)|\[(?:{_opaque('j')}|{_PLAIN})*+\])++"
)
_PIECE = rf"(?dU)(?:{_RUN}|[{{}}()\[\];]|(?s:.))"


def _bracketed(depth: int) -> str:
    inner = "" if depth == 0 else "|" + _bracketed(depth - 1)
    return rf"\[(?:{_STRING}|[^\[\]]{inner})*+\]"


_INNER_ATTRIBUTE = rf"#!\s*{_bracketed(_LEVELS - 1)}"
_INNER_DOC = r"(?://!|/\*!)"
_TRIVIA = rf"(?:\s++|(?!{_DOC}){_COMMENT}|(?={_INNER_DOC}){_COMMENT}|{_INNER_ATTRIBUTE})"
_ATTRIBUTE = rf"#\s*{_bracketed(_LEVELS - 1)}"
_LEAD = rf"(?:{_TRIVIA}|{_DOC}|{_ATTRIBUTE})*+"

_VIS = r"(?:pub\b(?:\s*\([^)]*\))?\s*)?"
_QUALIFIERS = r'(?:(?:default|const|async|unsafe|extern(?:\s*"[^"]*")?)\s+)*+'
_NAME = r"((?:r#)?[\p{IsAlphabetic}_]\w*)"
_HEAD = rf"(?dU)\A{_LEAD}{_VIS}(?:(use)\b|{_QUALIFIERS}(fn|struct|enum|type|impl)\b(?:\s+{_NAME})?)"
_PUBLIC = rf"(?dU)\A{_LEAD}pub\b(?!\s*\()"
# Text after which the previous "}" did not end an item.
_CONTINUES = rf"(?dU)\A(?:\s++|{_COMMENT})*+(?:[^\w#\s/:'\"]|else\b|as\b)"

_TOKEN = (
    rf"(?dU)(?:{_OPAQUE}|(?:r#)?[\p{{IsAlphabetic}}_]\w*+|\d\w*+(?:\.\d\w*+)?(?:(?<=[eE])[+-]\d++)?"
    r"|(?<=\s)(?:<<=|>>=|<<|>>)(?=\s)|\.\.\.|\.\.=|::|->|=>|==|!=|<=(?=\s)|>=(?=\s)|&&(?=\s)|\|\||[+\-*/%^&|]=|\.\.|\S)"
)
# What the complexity count looks at (group 2); opaque text comes first, so it is
# passed over.
_BRANCH_TOKEN = (
    rf"(?dU)(?:{_OPAQUE}|(?<![\w'])((?!(?:if|while|match|return|in|else|loop|break)\b)\w++\s*!\s*[({{\[]"
    r"|(?:if|while|loop|box)\b(?!\s*!\s*=)|=>|[{}()\[\]])|\w++|(?s:.))"
)

# --- items ------------------------------------------------------------------------


def pieces(content: Column) -> Column:
    """The text cut so that brackets stand alone and opaque text stays whole."""
    return F.regexp_extract_all(content, F.lit(_PIECE), F.lit(0))


def bracket_depth(ps: Column) -> Column:
    """Running bracket depth after each piece."""
    return prefix_sum(
        F.transform(
            ps,
            lambda p: F.when(p.isin("{", "(", "["), 1).when(p.isin("}", ")", "]"), -1).otherwise(0),
        )
    )


def _flat(content: Column) -> Column:
    return flat(content, pieces, _LEVELS)


def items(content: Column) -> Column:
    """Top-level items: kind, public flag, name and source text (attributes included).

    The text is flat; whatever prints part of it puts the replaced delimiters back.
    """

    def cut(ps: Column, depth: Column) -> Column:
        closers = F.filter(
            F.sequence(F.lit(1), F.size(ps)),
            lambda i: (F.get(depth, i - 1) == 0) & F.get(ps, i - 1).isin("}", ";"),
        )
        return let(closers, lambda ends: let(_between(ps, ends), lambda ts: let(_starts(ts), lambda s: _join(ts, s))))

    def describe(text: Column) -> Column:
        kind = F.concat(F.regexp_extract(text, _HEAD, 1), F.regexp_extract(text, _HEAD, 2))
        return F.struct(
            kind.alias("kind"),
            F.regexp_extract(text, _HEAD, 3).alias("name"),
            text.rlike(_PUBLIC).alias("public"),
            text.alias("text"),
        )

    found = let(
        pieces(_flat(content)), lambda ps: F.when(F.size(ps) > 0, let(bracket_depth(ps), lambda d: cut(ps, d)))
    )
    trimmed = F.transform(found, lambda t: F.regexp_replace(t, rf"(?dU)\A{_TRIVIA}++", ""))
    return F.filter(F.transform(trimmed, describe), lambda it: it["kind"] != "")


def _between(ps: Column, ends: Column) -> Column:
    return F.transform(
        ends,
        lambda e, j: let(
            F.when(j == 0, F.lit(0)).otherwise(F.get(ends, j - 1)),
            lambda before: F.array_join(F.slice(ps, before + 1, e - before), ""),
        ),
    )


def _starts(texts: Column) -> Column:
    """Positions (1-based) of the stretches that begin an item."""
    return F.filter(
        F.transform(texts, lambda t, i: F.when((i == 0) | ~t.rlike(_CONTINUES), i + 1).otherwise(0)),
        lambda i: i > 0,
    )


def _join(texts: Column, starts: Column) -> Column:
    return F.transform(
        starts,
        lambda s, j: F.array_join(F.slice(texts, s, F.coalesce(F.get(starts, j + 1), F.size(texts) + 1) - s), ""),
    )


def is_balanced(content: Column) -> Column:
    """False where brackets do not match up, which no Rust parser accepts."""
    return let(
        bracket_depth(pieces(_flat(content))),
        lambda d: (F.size(d) == 0) | ((F.element_at(d, -1) == 0) & (F.array_min(d) >= 0)),
    ) | (content == "")


# --- token text -------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Tokens in order; plain comments dropped, doc comments shown as attributes."""

    def show(t: Column) -> Column:
        mark = F.when(t.rlike(rf"\A{_INNER_DOC}"), F.lit("# ! [doc = \"")).otherwise(F.lit("# [doc = \""))
        inside = F.regexp_replace(F.regexp_replace(t, r"\A(?://|/\*).", ""), r"\*/\z", "")
        quoted = F.regexp_replace(F.regexp_replace(inside, r"([\"\\])", r"\\$1"), r"\n", r"\\n")
        return F.when(t.rlike(rf"(?dU)\A{_DOC}\z"), F.concat(mark, quoted, F.lit("\"]"))).otherwise(t)

    found = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    kept = F.filter(found, lambda t: ~t.rlike(r"\A/[/*]") | t.rlike(rf"(?dU)\A{_DOC}\z"))
    return F.transform(kept, show)


def token_text(text: Column) -> Column:
    """Tokens joined by single blanks, none just inside round or square brackets."""
    return let(
        tokens(text),
        lambda ts: F.array_join(
            F.transform(
                ts,
                lambda t, i: F.when(
                    (i == 0) | t.isin(")", "]") | F.coalesce(F.get(ts, i - 1).isin("(", "["), F.lit(False)), t
                ).otherwise(F.concat(F.lit(" "), t)),
            ),
            "",
        ),
    )


# --- tables of items --------------------------------------------------------------


def _printed(text: Column) -> Column:
    return with_comments(token_text(with_brackets(text)))


def _of_kind(its: Column, *kinds: str) -> Column:
    return F.filter(its, lambda it: it["kind"].isin(*kinds))


def imports_of(its: Column) -> Column:
    return F.transform(_of_kind(its, "use"), lambda it: _printed(it["text"]))


def types_of(its: Column) -> Column:
    return F.transform(_of_kind(its, "struct", "enum", "type", "impl"), lambda it: _printed(it["text"]))


def exports_of(its: Column) -> Column:
    public = F.filter(_of_kind(its, "fn", "struct", "enum", "type"), lambda it: it["public"])
    return F.transform(public, lambda it: F.concat(it["kind"], F.lit(" "), it["name"]))


def functions_of(its: Column, body_mode: str = "reference") -> Column:
    def split(it: Column) -> Column:
        code = with_brackets(F.regexp_replace(it["text"], rf"(?dU)\A{_LEAD}{_VIS}", ""))
        return let(
            code,
            lambda c: let(
                F.regexp_extract(c, rf"(?dU)\A(?:{_OPAQUE}|[^{{])*+", 0),
                lambda sig: F.struct(
                    it["name"].alias("name"),
                    token_text(sig).alias("signature"),
                    _inputs(sig).alias("inputs"),
                    F.substr(c, F.length(sig) + 1).alias("block"),
                    (count_of(it["text"], "\n") + 1).cast("bigint").alias("lines_of_code"),
                ),
            ),
        )

    def measure(f: Column) -> Column:
        body = (
            F.when(f["lines_of_code"] <= 20, token_text(f["block"])) if body_mode == "reference" else f["block"]
        )
        return F.struct(
            f["name"].alias("name"),
            with_comments(strip_signature_body(f["signature"])).alias("signature"),
            with_comments(signature_types(f["signature"])).alias("types"),
            with_comments(body).alias("body"),
            f["lines_of_code"].alias("lines_of_code"),
            cyclomatic(f["block"]).alias("cyclomatic_complexity"),
            f["inputs"]["n"].cast("bigint").alias("parameters"),
            f["inputs"]["returns"].alias("returns"),
            F.lit(None).cast("string").alias("summary"),
        )

    return F.transform(F.transform(_of_kind(its, "fn"), split), measure)


def imports(content: Column) -> Column:
    return imports_of(items(content))


def types(content: Column) -> Column:
    return types_of(items(content))


def exports(content: Column) -> Column:
    return exports_of(items(content))


def functions(content: Column, body_mode: str = "reference") -> Column:
    return functions_of(items(content), body_mode)


def signature_types(signature: Column) -> Column:
    """Whatever follows a colon in the signature, up to a comma or closing bracket."""
    found = F.regexp_extract_all(signature, F.lit(r"(?U):\s*([^,\)]+)"), F.lit(1))
    return F.array_join(F.transform(found, lambda t: F.regexp_replace(t, r"(?U)\A\s++|\s++\z", "")), ", ")


def strip_signature_body(signature: Column) -> Column:
    return F.regexp_replace(signature, r"(?d)\{.*\}", "{ ... }")


def _inputs(signature: Column) -> Column:
    """Fold over the signature's tokens: number of inputs, and whether "->" follows.

    ``at`` is 0 before the parameter list, 1 inside it, 2 right behind it, 3 after.
    """
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("some"), F.lit(0).alias("n"),
        F.lit(False).alias("returns"),
    )

    def step(s: Column, t: Column) -> Column:
        flat = s["depth"] == 0
        opening = (s["at"] == 0) & flat & (t == "(")
        closing = (s["at"] == 1) & flat & (t == ")")
        counted = (s["at"] == 1) & flat & t.isin(",", ")") & s["some"]
        move = F.when(opening | closing | (s["at"] > 1), 0).when(t.isin("(", "[", "<", "{"), 1)
        move = move.when(t.isin(")", "]", ">", "}"), -1).otherwise(0)
        return F.struct(
            F.when(opening, 1).when(closing, 2).when(s["at"] == 2, 3).otherwise(s["at"]).alias("at"),
            (s["depth"] + move).alias("depth"),
            F.when((s["at"] == 1) & flat & (t == ","), False).otherwise(s["some"] | (s["at"] == 1)).alias("some"),
            (s["n"] + counted.cast("int")).alias("n"),
            (s["returns"] | ((s["at"] == 2) & (t == "->"))).alias("returns"),
        )

    return F.aggregate(
        F.filter(F.regexp_extract_all(signature, F.lit(_TOKEN), F.lit(0)), lambda t: ~t.rlike(r"\A/[/*]")),
        start,
        step,
    )


def cyclomatic(block: Column) -> Column:
    """1 + if, while, loop, box and match arms; macro arguments are not looked into.

    ``macro`` is the depth at which the outermost macro call was entered (0: outside),
    ``cond`` the depth of an ``if`` whose "{" is still to come: an arrow found there
    first makes that ``if`` a match guard, which is not a branch of its own.
    """
    found = F.array_remove(F.regexp_extract_all(block, F.lit(_BRANCH_TOKEN), F.lit(2)), F.lit(""))
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("macro"), F.lit(-1).alias("cond"), F.lit(1).alias("n")
    )

    def step(s: Column, t: Column) -> Column:
        opens, closes = t.rlike(r"[({\[]\z"), t.isin("}", ")", "]")
        outside = s["macro"] == 0
        word = t.isin("if", "while", "loop", "box")
        guarded = (t == "=>") & (s["cond"] == s["depth"])
        entered = outside & opens & t.contains("!")
        return F.struct(
            F.when(opens, s["depth"] + 1).when(closes, s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
            F.when(entered, s["depth"] + 1)
            .when(closes & (s["macro"] == s["depth"]), 0)
            .otherwise(s["macro"])
            .alias("macro"),
            F.when(outside & (t == "if"), s["depth"])
            .when(outside & (s["cond"] == s["depth"]) & t.isin("{", "=>"), -1)
            .otherwise(s["cond"])
            .alias("cond"),
            F.when(outside & (word | ((t == "=>") & ~guarded)), s["n"] + 1).otherwise(s["n"]).alias("n"),
        )

    return F.aggregate(found, start, step, lambda s: s["n"].cast("bigint"))
