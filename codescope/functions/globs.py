"""Glob patterns as Java regular expressions (driver-side text, no matching here)."""

from __future__ import annotations

import re

_SPECIAL = set(".^$+(){}|[]\\*?")


def _literal(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def glob_regex(glob: str, crosses_slash: bool) -> str:
    """``*`` and ``?`` match ``/`` only with ``crosses_slash``; ``**`` stands for directories."""
    one = "." if crosses_slash else "[^/]"
    out, i, n, braces = [], 0, len(glob), 0
    while i < n:
        c = glob[i]
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/") and (i + 2 == n or glob[i + 2] == "/"):
            if i + 2 == n:
                out.append(".*" if i == 0 else ".+")
                i += 2
            else:
                out.append("(?:.*/)?")
                i += 3
            continue
        if c == "*":
            while i + 1 < n and glob[i + 1] == "*":
                i += 1
            out.append(one + "*")
        elif c == "?":
            out.append(one)
        elif c == "\\" and i + 1 < n:
            i += 1
            out.append(_literal(glob[i]))
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1 : end]
            negated = inside[0] in "!^"
            inside = inside[1:] if negated else inside
            inside = "".join("\\" + x if x in "\\[]^&" else x for x in inside)
            out.append(f"[{'^' if negated else ''}{inside}]")
            i = end
        elif c == "{":
            braces += 1
            out.append("(?:")
        elif c == "}" and braces:
            braces -= 1
            out.append(")")
        elif c == "," and braces:
            out.append("|")
        else:
            out.append(_literal(c))
        i += 1
    return "".join(out) + ")" * braces


def gitignore_rule(line: str) -> tuple[str, bool, bool] | None:
    """(regex on the path below the rule file's directory, negated, directories only)."""
    line = line.rstrip("\r")
    while line.endswith((" ", "\t")) and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    if negated:
        line = line[1:]
    directories = line.endswith("/")
    if directories:
        line = line[:-1]
    anchored = "/" in line
    line = line.removeprefix("/")
    if not line:
        return None
    above = "" if anchored else "(?:.*/)?"
    pattern = f"{above}{glob_regex(line, False)}"
    try:
        re.compile(pattern)
    except re.error:  # a malformed class or range: the line is no rule
        return None
    return rf"(?s)\A{pattern}\z", negated, directories
