"""Scalar text functions: Column in, Column out, all JVM-side but :func:`nfkc`."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns that decide results, those of clean_ascii below among them.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"\b\d{10}\b"
CODE = r"\b[A-Z]{2,}\d+\b"
TOKEN = r"\w+|[^\w\s]"
SENTENCE_END = r"(?<=[.!?])\s+"
#: What white space is.
BLANKS = " \t\n\x0b\f\r"


def strip(text: Column) -> Column:
    """Without blanks and line breaks at both ends; Spark's trim takes spaces only unless told otherwise."""
    return F.btrim(text, F.lit(BLANKS))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility normal form; ASCII texts never leave the JVM's row."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def clean_ascii(text: Column) -> Column:
    """The steps after normalisation, in their order: line breaks, blanks, characters, ends.

    Line breaks collapse before blanks do, so breaks with blanks between them stay.
    """
    t = F.regexp_replace(text, r"\n{3,}", "\n\n")
    # Single spaces stay as they are and need no match.
    t = F.regexp_replace(t, r"[ \t]{2,}|\t", " ")
    t = F.regexp_replace(t, r"[^\x09\x0A\x0D\x20-\x7E]+", "")
    return strip(t)


def clean_text(text: Column) -> Column:
    """Normalised, collapsed, printable ASCII, stripped. Accented letters go, ligatures and wide forms become plain."""
    return clean_ascii(nfkc(text))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s{2,}|[\t\n\x0B\f\r]", " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def phones(text: Column) -> Column:
    """Numbers of exactly ten digits."""
    return F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))


def codes(text: Column) -> Column:
    """Two or more capitals and then digits."""
    return F.regexp_extract_all(text, F.lit(CODE), F.lit(0))


# What stands before a person's name and after an organisation's.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame"
FORMS = "Inc|Ltd|LLC|Corp|Corporation|Company|Group|GmbH|AG|SA|SARL|SL|PLC|University|Institute|Foundation"
_PROPER = r"[A-Z][A-Za-z&'-]*"
PERSON = rf"\b(?:{TITLES})\.? {_PROPER}(?: {_PROPER})?"
ORGANISATION = rf"\b{_PROPER}(?: {_PROPER})* (?:{FORMS})\b"


def entities(text: Column, places: list[str] | None = None) -> Column:
    """The offline recogniser: names after a title, organisations by their legal form, and the ``places`` (or products) of a list of the caller's."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (PERSON, ORGANISATION)]
    if places:
        listed = "|".join(re.sub(r"([^\w\s])", r"\\\1", x) for x in sorted(set(places), key=lambda x: (-len(x), x)))
        found.append(F.regexp_extract_all(text, F.lit(rf"\b(?:{listed})\b"), F.lit(0)))
    return F.concat(*found)


def sensitive_terms(text: Column, entities: Column | None = None) -> Column:
    """Sorted distinct emails, phone numbers and codes, with ``entities`` (array of strings) from a recogniser."""
    parts = [emails(text), phones(text), codes(text)] + ([F.coalesce(entities, F.array().cast("array<string>"))] if entities is not None else [])
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def tokens(text: Column) -> Column:
    """Words and single signs."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """What white space separates."""
    t = squeeze(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def token_count(text: Column) -> Column:
    """The number of :func:`tokens`, without listing them."""
    return F.regexp_count(text, F.lit(TOKEN))


def word_count(text: Column) -> Column:
    """The number of :func:`words`, without listing them."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+"))


def sentences(text: Column) -> Column:
    """Sentences with their end marks, stripped, without blank ones; breaks inside stay."""
    # Split at the white space itself, so no sign of the text can be mistaken for a border.
    parts = F.split(text, SENTENCE_END)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def base_name(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def folder_of(path: Column, root: str) -> Column:
    """Folder of a path relative to ``root``; the root's own name for files right in it."""
    root = root.rstrip("/")
    folder = F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), r"/?[^/]*$", "")
    inside = F.regexp_replace(F.substring(folder, F.lit(len(root) + 1), F.length(folder)), r"^/+", "")
    return F.when(inside == "", F.lit(root.rsplit("/", 1)[-1])).otherwise(inside)
