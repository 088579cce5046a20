"""Personal data in plain and in disguised form, with places in the original characters.

Plain identifiers are matched on the text itself. For disguised ones a transducer rewrites
homoglyphs, invisible characters, spelled digits and at/dot disguises and keeps, for every rewritten
stretch, the source characters it stands for. The same detectors then run on the rewritten text, and
their spans are mapped back.
"""

from __future__ import annotations

import bisect
import hashlib
import re

from pyspark.sql import DataFrame, functions as F

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can begin only where a digit run begins, so the look-behind loses none.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Look-alike letters, invisible characters, digit words, domain endings.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j",
    "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "ո": "n", "ց": "g", "օ": "o",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "ɡ": "g", "ı": "i",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
    " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
               "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "co", "info", "biz", "de", "fr", "es", "uk",
           "us", "eu", "it", "nl", "ch", "at", "ca", "au", "example", "test")

_CHARS = {**LOOKALIKES, **{c: "" for c in INVISIBLE},
          **{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)},
          **{chr(b + d): str(d) for b in (0x660, 0x6F0, 0x966, *range(0x1D7CE, 0x1D800, 10))
             for d in range(10)}}
_CHAR = re.compile("[" + re.escape("".join(_CHARS)) + "]")
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(
    rf"(?i)(?<!\w)(?:plus[\s-]{{1,3}})?(?:{_WORD}|[0-9]+)(?:[\s,-]{{1,3}}(?:{_WORD}|dot|point|[0-9]+)(?!\w))+")
_ITEM = re.compile(rf"(?i){_WORD}|dot|point|plus|[0-9]+")
_BRACKET = re.compile(
    r"(?i)\s{0,3}[\[({<]\s{0,3}(at|@|dot|\.)\s{0,3}[\])}>]\s{0,3}"
    r"|(?<=[A-Za-z0-9])\s{1,3}(@)\s{0,3}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(@)\s{1,3}(?=[A-Za-z0-9])")
_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+")
_PLAIN = re.compile(
    r"(?i)(?<=[A-Za-z0-9])(\s{1,3}at\s{1,3})([a-z0-9-]{1,63}(?:(?:\s{1,3}dot\s{1,3}|\.)[a-z0-9-]{1,63}){0,5}"
    r"\s{1,3}dot\s{1,3}(?:" + "|".join(ENDINGS) + r"))(?![A-Za-z0-9-])")
_DOT = re.compile(r"(?i)\s{1,3}dot\s{1,3}")
_JOINT = re.compile(r"(?i)[\s,-]{1,3}(?:dot|point)[\s,-]{1,3}")
_QUAD = re.compile(
    r"(?i)(?<![0-9])[0-9]++(?:(?:[\s,-]{1,3}(?:dot|point)[\s,-]{1,3}|\.)[0-9]++){3}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of plain identifiers, leftmost and not overlapping per kind."""
    found, last = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            start = at = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = m.end()
                found.append((start, 0, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = m[0].split(".")
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


class Tape:
    """Rewritten text with the source span of every rewritten stretch."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends = None, None     # source start and end of each character, if rewritten
        self.changed: list[tuple[int, int]] = []   # source spans that were rewritten

    def source(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return self.starts[start], self.ends[end - 1]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the spans of the present text, given in order and not overlapping."""
        if not edits:
            return
        starts = self.starts if self.starts is not None else range(len(self.text))
        ends = self.ends if self.ends is not None else range(1, len(self.text) + 1)
        texts, new_starts, new_ends, at = [], [], [], 0
        for a, b, new in edits:
            texts += [self.text[at:a], new]
            new_starts += starts[at:a]
            new_ends += ends[at:a]
            new_starts += [starts[a]] * len(new)
            new_ends += [ends[b - 1]] * len(new)
            self.changed.append((starts[a], ends[b - 1]))
            at = b
        texts.append(self.text[at:])
        new_starts += starts[at:]
        new_ends += ends[at:]
        self.text, self.starts, self.ends = "".join(texts), new_starts, new_ends


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(text):
        items = [x.lower() for x in _ITEM.findall(m[0])]
        new = "".join("+" if x == "plus" else "." if x in ("dot", "point") else DIGIT_WORDS.get(x, x)
                      for x in items)
        if sum(c.isdigit() for c in new) >= 4 and any(x in DIGIT_WORDS for x in items):
            edits.append((m.start(), m.end(), new.strip(".")))
    return edits


def _disguises(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _BRACKET.finditer(text):
        if m[1]:
            edits.append((m.start(), m.end(), "@" if m[1].lower() in ("@", "at") else "."))
        elif _DOMAIN.match(text, m.end()):
            edits.append((m.start(), m.end(), "@"))
    return edits


def _plain_words(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _PLAIN.finditer(text):
        edits.append((m.start(1), m.end(1), "@"))
        edits += [(m.start(2) + d.start(), m.start(2) + d.end(), ".") for d in _DOT.finditer(m[2])]
    return edits


def _quads(text: str) -> list[tuple[int, int, str]]:
    """Four numbers joined by "dot"."""
    return [(d.start(), d.end(), ".") for m in _QUAD.finditer(text)
            for d in _JOINT.finditer(text, m.start(), m.end())]


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifiers that show only after rewriting, in source characters.

    Each transducer is left out only where the text lacks what every match of it must contain.
    """
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite([(m.start(), m.end(), _CHARS[m[0]]) for m in _CHAR.finditer(text)])
    low = tape.text.lower()
    if any(word in low for word in DIGIT_WORDS):
        tape.rewrite(_spelled(tape.text))
    if any(c in low for c in "@[({<"):
        tape.rewrite(_disguises(tape.text))
    if "dot" in low or "point" in low:
        tape.rewrite(_quads(tape.text))
    if "dot" in low:
        if "at" in low:
            tape.rewrite(_plain_words(tape.text))
        if "@" in tape.text:        # a plain "dot" after an "at" in brackets
            tape.rewrite([(d.start(), d.end(), ".") for m in re.finditer(
                r"(?i)@[a-z0-9-]{1,63}(?:(?:\s{1,3}dot\s{1,3}|\.)[a-z0-9-]{1,63}){0,5}", tape.text)
                for d in _DOT.finditer(tape.text, m.start(), m.end())])
    if not tape.changed:
        return []
    changed = sorted(tape.changed)
    begins, reach, top = [a for a, _ in changed], [], 0
    for _, b in changed:
        top = max(top, b)
        reach.append(top)
    spans = {k: [(a, b) for a, kind, b in base if kind == k] for k in range(4)}
    out = []
    for a, kind, b in identifiers(tape.text):
        start, end = tape.source(a, b)
        i = bisect.bisect_left(begins, end)
        if not i or reach[i - 1] <= start:
            continue                    # nothing inside was rewritten: the base has judged it
        if any(x <= start and end <= y for x, y in spans[kind]):
            continue
        out.append((start, kind, end))
    return sorted(set(out))


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data in every whole text.

    Returns id, base (array of kind, start, end in code points, end exclusive) for plain
    identifiers and added for disguised ones, both by start and kind. A null or empty text has
    none. Rows are judged alone; other columns are ignored; an empty table gives an empty one.
    """
    def make():
        def structs(spans):
            return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

        def run(columns):
            out = []
            for text in columns[1]:
                base = identifiers(text or "")
                out.append((structs(base), structs(disguised(text, base) if text else [])))
            return out
        return run

    spans = "array<struct<kind: string, start: long, end: long>>"
    return map_texts(docs, [id_column, text], f"base {spans}, added {spans}", make)


def redact_text(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    base = identifiers(text)
    spans = sorted(base + disguised(text, base))
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{KINDS[kind]}]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; a null text stays null."""
    rest = [c for c in docs.columns if c != text]

    def make():
        return lambda columns: [(None if t is None else redact_text(t),) for t in columns[-1]]

    done = map_texts(docs.withColumnRenamed(text, "__raw"), [*rest, "__raw"], f"`{text}` string", make)
    return done.select(*docs.columns)


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    def line(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def is_kind(kind):
        return lambda s: s["kind"] == kind
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        s["start"].alias("start"), order[s["kind"]].alias("n"), s["end"].alias("end"),
        s["kind"].alias("kind"))))
    return found.select(
        id_column,
        *[F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        line(every).alias("spans"), F.size("added").cast("long").alias("n_added"))
