"""Personal data, also in disguise.

Base: patterns for email, ip, card and phone on the text as it stands.  On top, transducers rewrite disguises (look-alike
letters and digits, invisible characters, spelled digits, "at" and "dot" in words or brackets) into a normal form in which
every character remembers the span of source characters that it came from; the same patterns run on that form, and what
they find is mapped back to source offsets.  A disguised find is added if it rests on a rewritten place and no base span of
its kind covers it wholly: base patterns often find a fragment of a disguised identifier.  All offsets count code points, ends are exclusive.

Every scan is linear in the text: patterns start at fixed points (an ``@``, the first digit of a run, a ``+``) and use
possessive runs.  Work is per row; nothing is shuffled.

Defined cases: a null text is empty and has no spans; texts are processed whole at any length; repeated rows are judged
alike; input columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lakegauge.llm.arrow import with_columns

KINDS = ["email", "ip", "card", "phone"]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """What the whole pattern finds from left to right: before each ``@`` the longest run of local characters."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    found = {"email": emails(text), "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        # by length first: a run of digits may be longer than int() takes
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


# fixed values: look-alikes of Latin letters, digits and marks, invisible characters, spelled digits
_LETTERS = {
    "а": "a", "А": "A", "В": "B", "с": "c", "С": "C", "ԁ": "d", "е": "e", "Е": "E", "Н": "H", "һ": "h", "і": "i", "І": "I",
    "ј": "j", "Ј": "J", "К": "K", "ӏ": "l", "М": "M", "о": "o", "О": "O", "р": "p", "Р": "P", "ԛ": "q", "ѕ": "s", "Ѕ": "S",
    "Т": "T", "ѵ": "v", "ԝ": "w", "х": "x", "Х": "X", "у": "y", "У": "Y",
    "α": "a", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "ι": "i", "Ι": "I", "Κ": "K", "Μ": "M", "ν": "v", "Ν": "N", "ο": "o",
    "Ο": "O", "ρ": "p", "Ρ": "P", "Τ": "T", "υ": "u", "Χ": "X", "Υ": "Y", "Ζ": "Z", "ı": "i", "ɡ": "g",
    "﹫": "@", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
_LETTERS |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
_LETTERS |= {chr(b + d): str(d) for b in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_INVISIBLE = "­​‌‍⁠﻿"
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
           "eight": "8", "nine": "9"}

_ODD = re.compile("[" + re.escape("".join(_LETTERS)) + _INVISIBLE + "]")
_ONE = "(?:" + "|".join(_DIGITS) + ")"
_NAME = r"[A-Za-z0-9-]"
_MARK = r"[\[({<]\s{0,3}%s\s{0,3}[\])}>]"
_DOT = rf"(?:\s{{0,3}}{_MARK % '(?:dot|punkt|punto|point)'}\s{{0,3}}|\s{{1,3}}dot\s{{1,3}})"
_AT = (rf"\s{{0,3}}{_MARK % '(?:at|@|arroba)'}\s{{0,3}}|(?<={_NAME})\s{{1,3}}at\s{{1,3}}(?={_NAME}+(?:\.{_NAME}+)*{_DOT}{_NAME})")
_TOKENS = re.compile(
    rf"(?P<at>{_AT})|(?P<dot>(?<={_NAME}){_DOT}(?={_NAME}))"
    rf"|(?P<digits>\b(?:plus[\s-]{{1,3}})?{_ONE}(?:[\s,-]{{1,3}}{_ONE}){{2,}}\b)|(?P<plus>\bplus[\s-]{{1,3}}(?=[0-9]))", re.I)
_HINT = re.compile(r"[\[({<]\s{0,3}(?:at|@|dot|arroba|punkt|punto|point)\s{0,3}[\])}>]|\sdot\s|\bplus[\s-]"
                   rf"|\b{_ONE}[\s,-]{{1,3}}{_ONE}[\s,-]{{1,3}}{_ONE}\b", re.I)
_SPELLED = re.compile(_ONE, re.I)


class Tape:
    """A text under rewriting; every character knows its source span and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))
        self.changed = bytearray(len(text))

    def rewrite(self, edits) -> None:
        """edits: (start, end, characters), from left to right.  Several characters for a span all map to the span,
        unless they come with spans of their own."""
        out, starts, ends, changed, at = [], [], [], bytearray(), 0
        for start, end, new in edits:
            out.append(self.text[at:start]); starts += self.starts[at:start]; ends += self.ends[at:start]; changed += self.changed[at:start]
            for char, a, b in new:
                out.append(char); starts.append(self.starts[a]); ends.append(self.ends[b - 1]); changed.append(1)
            at = end
        out.append(self.text[at:]); starts += self.starts[at:]; ends += self.ends[at:]; changed += self.changed[at:]
        self.text, self.starts, self.ends, self.changed = "".join(out), starts, ends, changed


def glyphs(text: str):
    for m in _ODD.finditer(text):
        yield m.start(), m.end(), [(c, m.start(), m.end()) for c in _LETTERS.get(m[0], "")]


def spoken(text: str):
    for m in _TOKENS.finditer(text):
        start, end = m.span()
        if m.lastgroup == "digits":
            plus = [("+", start, start + 4)] if m[0][:4].lower() == "plus" else []
            yield start, end, plus + [(_DIGITS[d[0].lower()], start + d.start(), start + d.end()) for d in _SPELLED.finditer(m[0])]
        else:
            yield start, end, [({"at": "@", "dot": ".", "plus": "+"}[m.lastgroup], start, end)]


def disguised(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Source spans of the finds that rest on rewritten characters."""
    odd = _ODD.search(text) if not text.isascii() else None
    if not odd and not _HINT.search(text):
        return {k: [] for k in KINDS}
    tape = Tape(text)
    if odd:
        tape.rewrite(glyphs(tape.text))
    tape.rewrite(spoken(tape.text))
    out = {}
    for kind, spans in detect(tape.text).items():
        taken, new = base[kind], []
        for start, end in spans:
            a, b = tape.starts[start], max(tape.ends[start:end])
            # rewritten inside, or an invisible character dropped inside
            if (any(tape.changed[start:end]) or b - a != end - start) and not any(x <= a and b <= y for x, y in taken):
                new.append((a, b))
        out[kind] = new
    return out


def find(text: str | None) -> tuple[list, list]:
    """(kind, start, end) of the base, and of all finds."""
    text = text or ""
    base = detect(text)
    more = disguised(text, base)
    listed = lambda f: [(k, a, b) for k in KINDS for a, b in sorted(f[k])]
    return listed(base), listed({k: base[k] + more[k] for k in KINDS})


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


def find_personal(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``."""
    def run(text):
        base, every = find(text)
        return tuple([{"kind": k, "start": a, "end": b} for k, a, b in x] for x in (base, every))

    return with_columns(docs, [f"`{text_col}`"], run, StructType([StructField("base_spans", SPANS), StructField("all_spans", SPANS)]), keep)


def redact(text: str | None, spans) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one, by the first kind."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def redact_personal(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all finds replaced in the text; same columns in the same order."""
    def run(text):
        return (redact(text, [{"kind": k, "start": a, "end": b} for k, a, b in find(text)[1]]),)

    return with_columns(docs, [f"`{text_col}`"], run, StructType([StructField(text_col, StringType())])).select(
        *[f"`{c}`" for c in docs.columns])


def op3_personal_data(spark, sf_dir) -> DataFrame:
    found = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(told("base_spans"), 256).alias("base_sha256"), told("all_spans").alias("spans"))
