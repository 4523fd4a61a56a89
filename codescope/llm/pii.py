"""Personal data in plain and disguised form: transducers normalise a text and keep every character's source."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds in the order of a row's digest, and what a match of each must hold besides.
KINDS = ("email", "ip", "card", "phone")
CARD_DIGITS, PHONE_DIGITS = range(12, 20), range(9, 16)

# Characters that look like another one, as pairs of (looks like, characters).
HOMOGLYPHS = (
    ("a", "аα"), ("b", "ЬƄ"), ("c", "сϲ"), ("d", "ԁ"), ("e", "еҽ"), ("g", "ɡ"), ("h", "һ"), ("i", "іıι"), ("j", "ј"), ("k", "кκ"), ("l", "ӏ"),
    ("m", "м"), ("n", "ո"), ("o", "оοօ"), ("p", "рρ"), ("q", "ԛ"), ("s", "ѕ"), ("t", "т"), ("u", "υս"), ("v", "ѵν"), ("w", "ԝ"), ("x", "хχ"), ("y", "у"), ("z", "ᴢ"),
    ("A", "АΑ"), ("B", "ВΒ"), ("C", "СϹ"), ("E", "ЕΕ"), ("H", "НΗ"), ("I", "ІΙ"), ("J", "Ј"), ("K", "КΚ"), ("M", "МΜ"), ("N", "Ν"), ("O", "ОΟ"), ("P", "РΡ"),
    ("S", "Ѕ"), ("T", "ТΤ"), ("X", "ХΧ"), ("Y", "УΥ"), ("Z", "Ζ"), (".", "。·•"), ("@", "ⓐ"),
)

# Digits in words.
DIGIT_WORDS = (
    "zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco",
    "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
)
TIMES_WORDS = {"double": 2, "doppel": 2, "triple": 3}

# Words for @ and the dot, and endings of a domain that is written with bare words.
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at arroba arobase", "dot punkt punto point", "plus más"
ENDINGS = frozenset("com org net edu gov mil int info biz name io co ai app dev uk de fr es nl ch eu ca au nz jp cn br mx ru pl se dk fi ie pt cz example test invalid localhost".split())

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]++")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of leftmost non-overlapping identifiers of each kind, by start and kind; linear in the text.

    Runs are taken whole, so no start inside a run is tried again: such a start could only fail like the run's own.
    """
    found = []
    floor, at = 0, text.find("@")
    while at >= 0:
        domain, start = _DOMAIN.match(text, at + 1), at
        if domain:
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                floor = domain.end()
                found.append((start, 0, floor))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) < 256 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS.start:
            digits = _NO_DIGIT.sub("", m[0])
            if len(digits) in CARD_DIGITS and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        own = m[0].rstrip(" ().-")
        if len(own) > 3 and len(_NO_DIGIT.sub("", own)) in PHONE_DIGITS:
            found.append((m.start(), 3, m.start() + len(own)))
    return sorted(found)


class Tape:
    """A text with, for each character, the stretch of the source text that it stands for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.first = np.arange(len(text))
        self.last = self.first + 1

    def rewrite(self, edits: list[tuple[int, int, str]] | str) -> None:
        """Replaces stretches (start, end, by), in order and apart; all characters of ``by`` stand for the whole stretch.

        A whole text instead of edits replaces character by character.
        """
        if isinstance(edits, str):
            self.text = edits
            return
        text, first, last, done = [], [], [], 0
        for start, end, by in edits:
            text += [self.text[done:start], by]
            first += [self.first[done:start], np.full(len(by), self.first[start])]
            last += [self.last[done:start], np.full(len(by), self.last[end - 1])]
            done = end
        self.text = "".join([*text, self.text[done:]])
        self.first = np.concatenate([*first, self.first[done:]])
        self.last = np.concatenate([*last, self.last[done:]])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.first[start]), int(self.last[end - 1])


def _character_table() -> dict[str, str]:
    """ASCII for look-alikes: the fixed ones, compatibility forms, digits, dashes and blanks of all scripts; nothing for invisible ones."""
    table = {c: plain for plain, like in HOMOGLYPHS for c in like}
    for code in [*range(0x80, 0x20000), *range(0xE0000, 0xE0080)]:
        c = chr(code)
        kind, wide = unicodedata.category(c), unicodedata.normalize("NFKC", c)
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F:
            table[c] = ""
        elif kind == "Nd":
            table[c] = str(unicodedata.digit(c))
        elif kind == "Pd":
            table[c] = "-"
        elif kind == "Zs":
            table[c] = " "
        elif len(wide) == 1 and "!" <= wide <= "~":
            table.setdefault(c, wide)
    return table


def _either(words: str) -> str:
    return "|".join(sorted(map(re.escape, words.split()), key=len, reverse=True))


class _Rules:
    """Compiled once in each worker."""

    def __init__(self) -> None:
        self.characters = _character_table()
        self.odd = re.compile("[" + "".join(re.escape(c) for c in sorted(self.characters) if c < "\u0250") + "\u0250-\U0010ffff]")  # may be in the table
        self.invisible = re.compile("[" + "".join(re.escape(c) for c, by in sorted(self.characters.items()) if not by) + "]+")
        self.visible = str.maketrans({c: by for c, by in self.characters.items() if by})
        self.alike = re.compile(r"(?<![A-Za-z0-9])(?=[0-9OoIl]{0,8}[0-9])[0-9OoIl]{2,}+(?![A-Za-z0-9])")
        self.digit = {w: str(k) for k, words in enumerate(DIGIT_WORDS) for w in words.split()}
        times = _either(" ".join(TIMES_WORDS))
        self.number = re.compile(rf"(?<![^\W_])(?:({times})[ -])?({_either(' '.join(DIGIT_WORDS))})(?![^\W_])", re.I)
        self.between = re.compile(r"[ \t,;/_-]{1,3}")
        self.dotted = re.compile(rf"[ \t_]{{0,2}}(?:{_either(DOT_WORDS)}|\.)[ \t_]{{0,2}}", re.I)
        self.plus = re.compile(rf"(?<![^\W_])(?:{_either(PLUS_WORDS)})[ \t]{{1,2}}(?=[0-9])", re.I)
        gap = r"[ \t]{0,2}"
        self.bracketed = re.compile(rf"(?<=[A-Za-z0-9]){gap}[\[({{<]{gap}(?:({_either(AT_WORDS)}|@)|{_either(DOT_WORDS)}|\.){gap}[\])}}>]{gap}(?=[A-Za-z0-9])", re.I)
        self.spaced_dot = re.compile(rf"(?<=[0-9])[ \t_]{{1,2}}(?:{_either(DOT_WORDS)})[ \t_]{{1,2}}(?=[0-9])", re.I)
        self.spaced_at = re.compile(rf"(?<=[A-Za-z0-9])(?:[ \t_]{{1,2}}(?:{_either(AT_WORDS)})[ \t_]{{1,2}}|@)(?=[A-Za-z0-9])", re.I)
        self.label = re.compile(r"[A-Za-z0-9-]++")
        self.dot = re.compile(rf"\.|[ \t_]{{1,2}}(?:{_either(DOT_WORDS)})[ \t_]{{1,2}}", re.I)
        self.dot_before = re.compile(rf"(?<=[A-Za-z0-9])[ \t_]{{1,2}}(?:{_either(DOT_WORDS)})[ \t_]{{1,2}}\Z", re.I)


_rules: list[_Rules] = []


def _look_alikes(rules: _Rules, text: str) -> str:
    own = text.translate(rules.visible) if not text.isascii() and rules.odd.search(text) else text
    return own if own != text else ""


def _invisible(rules: _Rules, text: str) -> list[tuple[int, int, str]]:
    if text.isascii() or not rules.odd.search(text):
        return []
    return [(m.start(), m.end(), "") for m in rules.invisible.finditer(text)]


def _digits_alike(rules: _Rules, text: str) -> str:
    """O for 0 and l or I for 1 in numbers."""
    own = str.maketrans("OoIl", "0011")
    found, n = rules.alike.subn(lambda m: m[0].translate(own), text)
    return found if n and found != text else ""


def _spelled(rules: _Rules, text: str) -> list[tuple[int, int, str]]:
    """Digits in words, two at least that only separators or a dot keep apart; separators go, dots stay."""
    hits = [(m.start(), m.end(), rules.digit[m[2].lower()] * TIMES_WORDS.get((m[1] or "").lower(), 1)) for m in rules.number.finditer(text) if m[2].lower() in rules.digit]
    joined = [bool(rules.between.fullmatch(text, a[1], b[0])) for a, b in zip(hits, hits[1:])]
    linked = [False, *(j or bool(rules.dotted.fullmatch(text, a[1], b[0])) for j, a, b in zip(joined, hits, hits[1:])), False]
    edits = []
    for k, hit in enumerate(hits):
        if linked[k] or linked[k + 1]:
            if linked[k] and joined[k - 1]:
                edits.append((hits[k - 1][1], hit[0], ""))
            edits.append(hit)
    return edits


def _plus(rules: _Rules, text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "+") for m in rules.plus.finditer(text)]


def _brackets(rules: _Rules, text: str) -> list[tuple[int, int, str]]:
    """(at), [dot], [.] and the like between letters or digits, whatever encloses them."""
    return [(m.start(), m.end(), "@" if m[1] else ".") for m in rules.bracketed.finditer(text)]


def _number_dots(rules: _Rules, text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), ".") for m in rules.spaced_dot.finditer(text)]


def _bare_words(rules: _Rules, text: str) -> list[tuple[int, int, str]]:
    """``name at host dot com``: words between blanks, only where they make up an address with a known ending.

    With a bare "at" a dot must be a word too, or the name must hold a digit or sign, as in ``j.doe at host.com``: "look at host.com" is prose.
    """
    edits: list[tuple[int, int, str]] = []
    for m in rules.spaced_at.finditer(text):
        if edits and m.start() < edits[-1][1]:
            continue
        right, at, own = [], m.end(), []
        label = rules.label.match(text, at)
        while label and (dot := rules.dot.match(text, label.end())):
            label = rules.label.match(text, dot.end())
            if label:
                own.append((dot.start(), dot.end(), "."))
                if label[0].lower() in ENDINGS:
                    right = own.copy()
        if not right:
            continue
        floor = edits[-1][1] if edits else 0
        start, left, bare = m.start(), [], m[0] != "@"
        while True:
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            dot = rules.dot_before.search(text, max(floor, start - 12), start) if bare else None
            if not dot:
                break
            left.append((dot.start(), dot.end(), "."))
            start = dot.start()
        words = [e for e in right if text[e[0] : e[1]] != "."]
        if words or (bare and (left or re.search(r"[0-9._%+-]", text[start : m.start()]))):
            edits += [*reversed(left), *([(m.start(), m.end(), "@")] if bare else []), *words]
    return edits


#: The transducers in their order; each reads what the one before wrote.
TRANSDUCERS = (_look_alikes, _invisible, _digits_alike, _spelled, _plus, _brackets, _number_dots, _bare_words)


def normalised(text: str) -> Tape | None:
    """The text without disguises, or None if there is none to undo."""
    if not _rules:
        _rules.append(_Rules())
    tape = None
    for transducer in TRANSDUCERS:
        edits = transducer(_rules[0], tape.text if tape else text)
        if edits:
            tape = tape or Tape(text)
            tape.rewrite(edits)
    return tape


def personal_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, plain) by start, kind and end: identifiers of the text itself, then those of its normalised form.

    The latter are mapped to source characters and left out where a plain one of the same kind covers them.
    """
    plain = detect(text)
    found = [(*x, True) for x in plain]
    tape = normalised(text)
    if tape:
        own = [([s for s, k, _ in plain if k == kind], [e for _, k, e in plain if k == kind]) for kind in range(len(KINDS))]
        for start, kind, end in detect(tape.text):
            start, end = tape.source(start, end)
            starts, ends = own[kind]
            k = bisect_right(starts, start) - 1
            if k < 0 or ends[k] < end:
                found.append((start, kind, end, False))
    return sorted(found, key=lambda x: (x[:3], not x[3]))


SPANS = "array<struct<start:int,kind:string,end:int,plain:boolean>>"


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    for k in range(0, batch.num_rows, 64):  # few texts as Python strings at a time
        yield from (t or "" for t in batch[column].slice(k, 64).to_pylist())


def find_personal(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for each row: identifiers (start, kind, end, plain) in code points, by start and kind.

    ``plain`` ones stand in the text as they are, others come out once look-alike and invisible characters, digits in words and
    written-out at and dot are undone. Null and empty texts have no span; repeated rows are rows; other columns, whatever their names, are ignored.
    Each text is read whole, in time linear in its length.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("plain", pa.bool_())])
        for batch in batches:
            spans = [[{"start": a, "kind": KINDS[k], "end": b, "plain": p} for a, k, b, p in personal_spans(t)] for t in _texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    return own.mapInArrow(scan, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redacted(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each identifier replaced by its kind in angle brackets; overlapping ones by the first's. Null texts stay null."""

    def cut(text: str) -> str:
        out, done = [], 0
        for start, kind, end, _ in personal_spans(text):
            if start >= done:
                out += [text[done:start], f"<{KINDS[kind].upper()}>"]
            done = max(done, end)
        return "".join([*out, text[done:]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            texts = pa.array([t if n else None for t, n in zip(map(cut, _texts(batch, text_col)), batch[at].is_valid().to_pylist())], batch.schema.types[at])
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(scan, docs.schema)


def personal_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_<kind> of the plain spans, base_sha256 of these and spans as text, and n_added of the others."""
    text = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    plain = F.filter("spans", lambda x: x["plain"])
    of = lambda kind: F.filter(plain, lambda x: x["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    added = F.size(F.filter("spans", lambda x: ~x["plain"])).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(text(plain), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), added)
