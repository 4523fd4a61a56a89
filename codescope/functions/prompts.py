"""Prompt texts for function summaries, and reading stored responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, lines_of

# Prompt wording.
PROVIDER_PREFIX = "Summarize this function in one line: "
OPENING = {
    "rust": "Summarize the following Rust function:",
    "javascript": "Summarize the following JavaScript/TypeScript function:",
    "python": "Summarize the following Python function:",
}
NO_BODY = {"rust": "(function body omitted)"}
NO_BODY_DEFAULT = "(Function body not available)"
LARGE_OPENING = "Summarize this large Rust function:"
LARGE_PARTS = "Function body in parts:"
LARGE_CLOSING = "Please provide a summary of the function's purpose and behavior based on these parts."
LARGE_LINES = 200
PART_LINES = 5


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def build_prompt(language: str, name: Column, signature: Column, types: Column, body: Column) -> Column:
    """Prompt for a function of ordinary size. JavaScript leaves the types out."""
    no_body = NO_BODY.get(language, NO_BODY_DEFAULT)
    shown_types = () if language == "javascript" else ("\nTypes: ", types)
    return _joined(
        OPENING.get(language, "Summarize the following function:"), "\n\nName: ", name, "\nSignature: ", signature,
        *shown_types, "\nBody: ", F.coalesce(body, F.lit(no_body)),
    )


def prompt_parts(body: Column) -> Column:
    """Body lines in parts of five; none for a missing body."""
    def cut(lines: Column) -> Column:
        starts = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines), F.lit(PART_LINES))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda s: F.array_join(F.slice(lines, s, F.lit(PART_LINES)), "\n"))

    return let(lines_of(F.coalesce(body, F.lit(""))), cut)


def build_large_prompt(name: Column, signature: Column, types: Column, body: Column) -> Column:
    parts = F.transform(
        prompt_parts(body),
        lambda text, i: _joined("\nPart ", (i + 1).cast("string"), ":\n", text, "\n\nTypes: ", types, "\n"),
    )
    return _joined(
        LARGE_OPENING, "\n\nName: ", name, "\nSignature: ", signature, "\nTypes: ", types, "\n\n", LARGE_PARTS, "\n",
        F.array_join(parts, ""), "\n", LARGE_CLOSING,
    )


def is_large(lines_of_code: Column) -> Column:
    return lines_of_code > LARGE_LINES


def provider_prompt(prompt: Column) -> Column:
    return _joined(PROVIDER_PREFIX, prompt)


def extract_response(provider: Column, body: Column) -> Column:
    """Answer text of a stored response; '' if it has none, null if it is not JSON."""

    def text(v: Column) -> Column:
        def string_at(path: str) -> Column:
            found = F.try_variant_get(v, path, "variant")
            # Strings only: a number or an object is not an answer.
            return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))

        answer = F.when(provider == "generate", string_at("$.response")).otherwise(
            string_at("$.choices[0].message.content")
        )
        return F.when(v.isNotNull(), F.coalesce(answer, F.lit("")))

    return let(F.try_parse_json(body), text)
