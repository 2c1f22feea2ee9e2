"""Personal data in whole texts, plain or disguised, with source offsets.

Plain identifiers are matched on the text as it stands. Then a chain of transducers rewrites
homoglyphs, spelled digits and at/dot disguises, keeping for every character the piece of source it
came from; the same detectors run on the rewritten text, and spans that use a rewritten character
are mapped back to the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import map_text

KINDS = ("email", "ip", "card", "phone")

Span = tuple[str, int, int]

# What the base detectors accept.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Every ip, card and phone lies within one such stretch.
NUMERIC = re.compile(r"[+0-9][0-9 ().-]*")
#: The look-behind and the possessive quantifiers change no match; they keep long runs of digits linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """The regular expression's matches, found from each at sign outwards, so in linear time."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """Plain identifiers, leftmost and non-overlapping in each kind, by kind and start."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    found["email"] = emails(text)
    for zone in NUMERIC.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        for m in IP.finditer(text, a, b):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                found["ip"].append(("ip", *m.span()))
        if b - a >= 16:
            for m in CARD.finditer(text, a, b):
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(("card", *m.span()))
        if text[a] == "+" and (m := PHONE.match(text, a, b)) and 8 <= sum(map(str.isdigit, m[0])) <= 15:
            found["phone"].append(("phone", *m.span()))
    return [s for k in KINDS for s in found[k]]


# Cyrillic and Greek letters that look like Latin ones, and signs that look like others.
LOOKALIKE = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅ", "aeopcyxijshdqwABEKMHOPCTXIJS", strict=True))
LOOKALIKE |= dict(zip("οινρυαΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oivpuaABEZHIKMNOPTYX", strict=True))
LOOKALIKE |= dict(zip("‐‑‒–—−․。﹫＠", "------..@@", strict=True))
#: Characters without width.
UNSEEN = "­​‌‍‎‏⁠﻿"
#: Digits by name, English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

DIGITS = frozenset("0123456789")
ODD = re.compile("[­Ͱ-ϿЀ-ԯ -⁠⁰-₟℀-⅏−①-⓿。﹠-﹯﻿！-～\U0001d400-\U0001d7ff]")
_NAME = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
#: Four or more digits by name (or single digits between them), with at most a sign and blanks between.
NAMES = re.compile(rf"(?i)\b(?:plus[ ,.-]{{0,3}})?{_NAME}(?:(?:[ ,.-]{{1,3}}|[ ,]{{0,2}}\bdot\b[ ,]{{0,2}})(?:{_NAME}|[0-9])){{3,}}\b")
NAME = re.compile(rf"(?i)plus|dot|{_NAME}|[0-9]")
#: A digit by name, as a word or beside digits.
SPOKEN = re.compile(rf"(?i)(?<![^\W\d_]){_NAME}(?![^\W\d_])")
#: What may stand between the parts of a number.
BETWEEN = " ,.()-"
PLUS = re.compile(r"(?i)(?<![^\W\d_])plus[ ,.-]{0,3}(?=\(?[0-9])")
_DOT = r"(?:\s*[\[({<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|punto|point)\s+|_dot_)"
_AT = r"(?:\s*[\[({<]\s*(?:at|arroba|arobase|@)\s*[\])}>]\s*|\s+@\s+|_at_)"
#: Words after which dot or point is a noun ("at the dot on", "at this point we"), and the endings that count even then.
_NOUN = "the|an?|this|that|some|any|every|each|one|no|which|what|another|either|same|my|your|his|her|its|our|their|boiling|melting|freezing|breaking|turning|tipping|starting|dew|gun|knife|mid"
_TOP = "com|org|net|edu|gov|mil|int|info|biz|dev|app|io|ai|me|eu|us|uk|de|fr|es|it|nl|ch|at|be|pt|se|no|dk|fi|pl|cz|ru|cn|jp|kr|in|br|mx|ar|ca|au|nz|za"
#: A host that is no single noun with dot or point, and has a dot in disguise.
_HOST = rf"(?!(?:{_NOUN}){_DOT}(?!(?:{_TOP})\b)[A-Za-z0-9-]++(?!(?:\.|{_DOT})[A-Za-z0-9]))[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+{_DOT}[A-Za-z0-9]"
#: An at sign in disguise before a host; a bare word counts only if a dot of the host is disguised too.
AT = re.compile(rf"(?i)(?<=[\w.%+-])(?:{_AT}(?=[A-Za-z0-9-]+(?:\.|{_DOT})[A-Za-z0-9])|\s+(?:at|arroba|arobase)\s+(?={_HOST}))")
DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9])")
#: What AT and DOT need; tells most texts apart cheaply.
HINT = re.compile(r"(?i)\b(?:dot|punkt|punto|point)\b|_dot_|[\[({<]\s*(?:at|arroba|arobase|@|\.)\s*[\])}>]|\s@\s|_at_")


class Tape:
    """A text under rewriting: characters, and for each the source piece it stands for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.new = bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces pieces; edits are in order and disjoint. A deleted piece joins nothing."""
        text, start, end, new, at = [], [], [], bytearray(), 0
        for a, b, put in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            new += self.new[at:a]
            if put:
                text.append(put)
                start += [self.start[a]] * len(put)
                end += [self.end[b - 1]] * len(put)
                new += b"\1" * len(put)
            elif b > a and new:
                new[-1] = 1
            at = b
        self.text, self.start, self.end, self.new = "".join(text), start, end, new


def glyphs(tape: Tape) -> None:
    edits = []
    for m in ODD.finditer(tape.text):
        c = m[0]
        put = "" if c in UNSEEN else LOOKALIKE.get(c) or unicodedata.normalize("NFKC", c)
        if put != c and put.isascii():
            edits.append((*m.span(), put))
    tape.rewrite(edits)


def numbers(tape: Tape) -> None:
    edits = []
    for m in NAMES.finditer(tape.text):
        at = m.start()
        for x in NAME.finditer(tape.text, *m.span()):
            word = x[0].lower()
            put = "+" if word == "plus" else "." if word == "dot" else SPELLED.get(word, word)
            if x.start() > at:
                edits.append((at, x.start(), ""))
            edits.append((*x.span(), put))
            at = x.end()
    tape.rewrite(edits)


def spoken(text: str) -> list[tuple[int, int, str]]:
    """Edits for every digit by name that adjoins digits or other names of digits, and for what stands between.

    Blanks, commas and hyphens between two names go, so that they form one number; beside digits a
    blank or hyphen stays, so that separate numbers do. Dots and brackets stay.
    """
    found = [m for m in SPOKEN.finditer(text) if m[0].lower() in SPELLED]
    joins = []
    for m, after in zip([None, *found], [*found, None], strict=True):
        a, b = m.end() if m else 0, after.start() if after else len(text)
        left, right = a, b
        while m and left < b and text[left] in BETWEEN:
            left += 1
        if left == b and m and after:
            joins.append((b, b))
            continue
        while after and right > left and text[right - 1] in BETWEEN:
            right -= 1
        joins.append((left if m and left < b and text[left] in DIGITS else None, right if after and right > a and text[right - 1] in DIGITS else None))
    edits = []
    for i, m in enumerate(found):
        before, behind = joins[i][1], joins[i + 1][0]
        if before is None and behind is None:
            continue
        a, b = m.span()
        if before is not None and before < a:
            edits.append((before, a, between(text[before:a], False)))
        edits.append((a, b, SPELLED[m[0].lower()]))
        if behind is not None and behind > b:
            edits.append((b, behind, between(text[b:behind], i + 1 < len(found) and behind == found[i + 1].start())))
    return edits


def partly_spoken(tape: Tape) -> None:
    tape.rewrite(spoken(tape.text))
    tape.rewrite([(*m.span(), "+") for m in PLUS.finditer(tape.text)])


def between(gap: str, names: bool) -> str:
    if any(c in gap for c in ".()"):
        return gap.replace(",", "")
    return "" if names else "-" if "-" in gap else " "


def signs(tape: Tape) -> None:
    tape.rewrite([(*m.span(), "@") for m in AT.finditer(tape.text)])
    tape.rewrite([(*m.span(), ".") for m in DOT.finditer(tape.text)])


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Disguised identifiers as source spans; none overlaps a base span or another of its kind."""
    if not text:
        return []
    odd = not text.isascii() and ODD.search(text)
    if not (odd or HINT.search(text) or PLUS.search(text) or spoken(text)):
        return []
    # Disjoint in each kind, so sorted by start and by end alike.
    out, taken = [], {k: sorted(s[1:] for s in base if s[0] == k) for k in KINDS}
    # Numbers as they are written, or else runs of names with all signs between them left out.
    for steps in ((signs, partly_spoken), (numbers, signs)):
        tape = Tape(text)
        if odd:
            glyphs(tape)
        for step in steps:
            step(tape)
        for kind, a, b in base_spans(tape.text):
            if not any(tape.new[a:b]):
                continue
            start, end = tape.start[a], tape.end[b - 1]
            have = taken[kind]
            at = bisect_left(have, (start, end))
            if (at == 0 or have[at - 1][1] <= start) and (at == len(have) or end <= have[at][0]):
                have.insert(at, (start, end))
                out.append((kind, start, end))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scanner() -> Callable[[list], list[list]]:
    def one(text: str | None) -> tuple:
        text = text or ""
        base = base_spans(text)
        more = added_spans(text, base)
        every = sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1])) if more else base
        counts = [sum(s[0] == k for s in base) for k in KINDS] if base else [0, 0, 0, 0]
        return *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(more), [{"kind": k, "start": a, "end": b} for k, a, b in every]

    def work(texts: list) -> list[list]:
        found = [one(x) for x in texts]
        return [list(x) for x in zip(*found, strict=True)] if found else [[] for _ in range(8)]

    return work


def find_pii(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Personal data of every whole text, one row for each row of ``docs``.

    Returns ``keep`` (doc_id), the number of plain spans of each kind (n_email, n_ip, n_card,
    n_phone), base_sha256 of the plain spans, spans (all, written ``kind:start:end``), n_added (the
    disguised ones) and found (all spans as an array). Offsets are code points, the end exclusive.
    A null text counts as empty: no spans. Rows are independent, so repeats, ties and nulls in other
    columns change nothing, and other columns are not read. An empty table gives an empty one. Very
    long texts are read whole, in time that follows their length, also where they are one run of
    digits or hold tens of thousands of disguises.

    Limits: digits by name are those of ``SPELLED``, each a word or beside digits ("fivefive" is none).
    Plain spans keep their extent: of '+1 743 555 38 two four' the plain part is the span. A digit by
    name that follows a disguised number counts as its part. After a bare "at", a host needs a
    disguised dot; after a noun's word (``_NOUN``: "at the dot on") as its only label, one of the
    endings in ``_TOP`` too.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    fields = [(f"n_{k}", "bigint", pa.int64()) for k in KINDS]
    fields += [("base_sha256", "string", pa.string()), ("spans", "string", pa.string()), ("n_added", "bigint", pa.int64())]
    fields += [("found", "array<struct<kind:string,start:int,end:int>>", kind)]
    return map_text(docs, keep or ["doc_id"], scanner, fields)
