"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of training text. A text is encoded once
with each dictionary; the smallest encoding names its language. If the runner-up is nearly as small,
the text is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import map_text

OTHER = re.compile(r"[\W\d_]+")

#: Long texts are encoded in blocks of so many bytes, so that what a text says about itself doesn't hide the dictionary.
BLOCK = 4096
#: The encoder's level, for texts of any length.
LEVEL = 6
#: Long training texts are sampled at so many places.
PIECES = 16
#: Follows every block. It costs a few bytes whatever the dictionary, and keeps the encoder from storing short blocks as they are.
PAD = bytes(256)


@dataclass(frozen=True)
class Languages:
    """A trained model: languages by falling number of training texts, and the dictionary of each."""

    names: list[str]
    dictionaries: list[bytes]


def letters(text: str) -> str:
    """Lower case, with each run of other characters as one space."""
    return OTHER.sub(" ", text.lower()).strip()


def spread(pieces: list[str], most: int) -> str:
    """About ``most`` bytes of a text, by :func:`letters`, in equal parts of whole characters from the start of each of its pieces."""
    return " ".join(letters(x).encode()[: max(1, most // len(pieces))].decode(errors="ignore") for x in pieces)


def level_of(sizes: list[int], total: int) -> int:
    """The largest share a text may have so that all together have ``total`` at most."""
    left, low = total, 0
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) > left:
            return left // (len(sizes) - i)
        left, low = left - n, n
    return low


def train(rows: DataFrame, texts_each: int = 96, bytes_each: int = 98_304) -> Languages:
    """Fits dictionaries to ``rows`` (doc_id, text, lang).

    A bounded sample: of each language, the ``texts_each`` texts whose ids hash lowest, up to about
    ``bytes_each`` bytes in all, shared out so that no text has more than another unless that one is
    shorter, nor more than an eighth. What a longer text gives are passages from ``PIECES`` places,
    spread evenly from its start to its end. The bounds hold a language; languages have no bound.

    Rows whose lang is null or whose text is null or has no letter don't count. Rows that repeat
    count each; ties in the hash go by id and text, so reruns give the same model. Without usable
    rows the model knows no language. Other columns are not read. The window keeps that many rows of
    a language in each task before anything is shuffled.
    """
    use = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "text")
    picked = use.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= texts_each)
    counts = {r["lang"]: r["n"] for r in use.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts: dict[str, list] = {}
    # What reaches the driver is bounded: a dictionary holds no more than bytes_each anyway.
    most, length = bytes_each // 8, F.length("text")
    size = F.least(F.ceil(length / PIECES), F.lit(bytes_each // PIECES)).cast("int")
    at = F.sequence(F.lit(0), F.lit(PIECES - 1))
    passage = lambda i: F.substring(F.col("text"), F.floor(length * i / PIECES).cast("int") + 1, size)
    pieces = F.when(length <= most, F.array("text")).otherwise(F.transform(at, passage))
    for r in picked.select("lang", "rank", pieces.alias("pieces")).toLocalIterator():
        parts.setdefault(r["lang"], []).append((r["rank"], [letters(x) for x in r["pieces"]]))
    names = sorted(parts, key=lambda x: (-counts[x], x))
    texts = []
    for name in names:
        own = [x for _, x in sorted(parts[name])]
        # No text may fill a dictionary by itself.
        share = level_of([min(most, len(" ".join(x).encode())) for x in own], bytes_each)
        texts.append([spread(x, share) for x in own])
    return fit(names, texts)


def fit(names: list[str], texts: list[list[str]]) -> Languages:
    """Dictionaries of texts that were prepared by :func:`letters`.

    Texts can quote other languages. So the two halves of the texts check each other: of each half,
    only passages go into the final dictionary that the other half's dictionaries put in the same
    language. A language of which nothing would be left keeps all.
    """
    passages = [[[y for x in group[half::2] for y in cut_up(x)] for half in (0, 1)] for group in texts]
    joined = lambda parts: " ".join(parts).encode()
    checks = [scorer(Languages(names, [joined(p[half]) or b" " for p in passages]), 0.0) for half in (0, 1)]
    made = []
    for name, p in zip(names, passages, strict=True):
        kept = [y for half in (0, 1) for y, found in zip(p[half], checks[1 - half](p[half])[0], strict=True) if found == name]
        made.append(joined(kept or p[0] + p[1]))
    return Languages(names, made)


def cut_up(text: str, length: int = 240) -> list[str]:
    """Passages of whole words, of about ``length`` characters."""
    out, words = [], text.split(" ")
    while words:
        n = size = 0
        while n < len(words) and size < length:
            size += len(words[n]) + 1
            n += 1
        out.append(" ".join(words[:n]))
        words = words[n:]
    return out


def scorer(model: Languages, margin: float) -> Callable[[list], list[list]]:
    """A function from texts to their language, score and rejection."""

    def coder(raw: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False)

    coders = [coder(x) for x in model.dictionaries]
    empty = len(coders[0].compress(PAD)) if coders else 0

    def one(text: str | None) -> tuple[str, float, bool]:
        if not model.names or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        raw = letters(text).encode()
        sizes = [0] * len(model.names)
        for at in range(0, len(raw), BLOCK):
            block = raw[at : at + BLOCK]
            for i, c in enumerate(coders):
                sizes[i] += len(c.compress(block + PAD)) - empty
        low = min(sizes)
        first = sizes.index(low)
        rest = sorted(sizes[:first] + sizes[first + 1 :])
        gap = (rest[0] - low) / max(1, rest[0]) if rest else 1.0
        score = 1 / sum(2.0 ** max(-60.0, (low - s) / 2) for s in sizes)
        return model.names[first], score, gap < margin

    def work(texts: list) -> list[list]:
        found = [one(x) for x in texts]
        return [list(x) for x in zip(*found, strict=True)] if found else [[], [], []]

    return work


def identify(docs: DataFrame, model: Languages, margin: float = 0.02, keep: list[str] | None = None) -> DataFrame:
    """Language of every whole text: the columns ``keep`` (doc_id), best_lang, score and rejected.

    ``score`` is the share of the best language when every two bytes that another encoding takes
    more halve its weight. ``rejected`` tells that the runner-up is within ``margin`` of the best.
    Texts that are null or have no letter get ``und``, score 0 and are rejected; so does every text
    if the model knows no language. Very long texts are encoded whole, block by block. Ties go to the
    language with more training texts. Repeated rows each get their row; an empty table gives an
    empty one. Columns other than ``keep`` and text are neither read nor returned.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # bounded: bytes_each a language
    fields = [("best_lang", "string", pa.string()), ("score", "double", pa.float64()), ("rejected", "boolean", pa.bool_())]
    return map_text(docs, keep or ["doc_id"], lambda: scorer(shared.value, margin), fields)
