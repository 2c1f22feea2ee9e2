"""Benchmark decontamination with spaced seeds.

A seed hashes the words under the ones of a fixed mask and ignores those under its zeros, so it
survives substituted words. Seeds of the test items are joined with those of the training texts;
around each hit the two word sequences are compared position by position.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, keep_text

#: Any 10 words of which any 2 are substituted hold a seed of one of these masks.
MASKS = ("1111", "11011", "1101001", "110011")

#: Pairs of positions with a common seed that are in memory at a time.
PAIRS = 1 << 20

#: Windows up to this many words have masks of their own, since those above miss some of their substitutions.
SHORT = 5

MIX = np.uint64(0x9E3779B97F4A7C15)


def seed_keys(words: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which all words under the mask's ones are known (not 0), and the seeds there."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    parts = [words[i : i + n] for i, c in enumerate(mask) if c == "1"]
    at = np.flatnonzero(np.logical_and.reduce([p != 0 for p in parts]))
    h = np.zeros(len(at), np.uint64)
    for p in parts:
        h = (h ^ p[at].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(31)
    return at, h


def short_masks(words: int, least: float) -> list[str]:
    """All masks of so many words whose ones are as many as have to agree."""
    ones = min(words, max(1, math.ceil(least * words - 1e-9)))
    return ["".join("1" if i in use else "0" for i in range(words)) for use in itertools.combinations(range(words), ones)]


class Index:
    """Words and seeds of test items."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...], window: int = 10, least: float = 0.8) -> None:
        self.words, self.ids, self.items = {}, [], []
        found: dict[str, list] = {mask: [] for mask in masks}
        for item_id, text in items:
            tokens = WORD.findall((text or "").lower())
            own = np.fromiter((self.words.setdefault(w, len(self.words) + 1) for w in tokens), np.int64, len(tokens))
            size = min(window, len(own))
            more = short_masks(size, least) if len(own) > 1 and size <= SHORT else []
            for mask in dict.fromkeys([*masks, *more]):
                at, keys = seed_keys(own, mask)
                found.setdefault(mask, []).append((keys, np.full(len(at), len(self.items)), at))
            self.ids.append(item_id)
            self.items.append(own)
        self.masks, self.seeds = tuple(found), []
        for parts in found.values():
            keys = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
            order = np.argsort(keys, kind="stable")
            self.seeds.append((keys[order], *(np.concatenate([p[i] for p in parts])[order] if parts else np.empty(0, np.int64) for i in (1, 2))))

    def hits(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """For each item with a common seed, the diagonals (position in the text less that in the item) that have one, sorted.

        Pairs of positions are expanded and made distinct piece by piece. A seed that occurs often in
        both texts has too many pairs for that: of one, the positions become the bits of a whole
        number, which is shifted by each position of the other, so pairs are never listed.
        """
        found: dict[int, list[np.ndarray]] = {}
        for mask, (keys, item, pos) in zip(self.masks, self.seeds, strict=True):
            at, h = seed_keys(words, mask)
            if not len(at) or not len(keys):
                continue
            lo = np.searchsorted(keys, h, "left")
            n = np.searchsorted(keys, h, "right") - lo
            some = np.flatnonzero(n)
            if not len(some):
                continue
            if n[some].sum() > PAIRS:
                own, first, times = np.unique(lo[some], return_index=True, return_counts=True)
                often = own[times * n[some][first] > PAIRS // 64]
                for start in often:
                    self.shifted(found, at[some[lo[some] == start]], item, pos, int(start), int(n[some[lo[some] == start][0]]))
                some = some[~np.isin(lo[some], often)]
            ends, begin = np.cumsum(n[some]), 0
            while begin < len(some):
                stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
                part = some[begin:stop]
                who = np.repeat(part, n[part])
                where = lo[who] + np.arange(len(who)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                put(found, item[where], at[who] - pos[where])
                begin = stop
        return {i: np.unique(np.concatenate(x)) for i, x in found.items()}

    @staticmethod
    def shifted(found: dict[int, list[np.ndarray]], at: np.ndarray, item: np.ndarray, pos: np.ndarray, start: int, n: int) -> None:
        """Adds the diagonals of one seed: at ``at`` in the text, and the ``n`` entries from ``start`` of the items."""
        for i in np.unique(item[start : start + n]):
            other = pos[start : start + n][item[start : start + n] == i]
            few, many, sign = (other, at, -1) if len(other) <= len(at) else (at, other, 1)
            low, high = int(many.min()), int(few.min() if sign > 0 else few.max())
            flags = np.zeros(int(many.max()) - low + 1, np.uint8)
            flags[many - low] = 1
            if sign > 0:  # diagonals are few - many: turn the flags round
                flags, low = flags[::-1], -int(many.max())
            bits, out = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little"), 0
            for f in few.tolist():
                out |= bits << (f - high if sign > 0 else high - f)
            raw = np.frombuffer(out.to_bytes(out.bit_length() // 8 + 1, "little"), np.uint8)
            found.setdefault(int(i), []).append(np.flatnonzero(np.unpackbits(raw, bitorder="little")) + low + (high if sign > 0 else -high))

    def overlaps(self, text: str, window: int, least: float) -> dict[int, tuple[int, int, int]]:
        """For each item that the text holds, the overlap of most agreeing words, then the first: start and end in words of the text, and words that agree."""
        tokens = WORD.findall(text.lower())
        known = self.words
        words = np.fromiter((known.get(w, 0) for w in tokens), np.int64, len(tokens))
        best: dict[int, tuple[int, int, int]] = {}
        for item, diagonals in sorted(self.hits(words).items()):
            own = self.items[item]
            w = min(window, len(own))
            room = np.minimum(len(own), len(words) - diagonals) - np.maximum(0, -diagonals)
            # From the longest on, as no overlap has more words that agree than its diagonal has.
            for k in np.argsort(-room, kind="stable"):
                if room[k] < w or (item in best and room[k] < best[item][2]):
                    break
                diagonal = int(diagonals[k])
                a = max(0, -diagonal)
                b = a + int(room[k])
                same = np.concatenate([[0], np.cumsum(own[a:b] == words[a + diagonal : b + diagonal])])
                good = np.flatnonzero(same[w:] - same[:-w] >= least * w - 1e-9)
                if len(good):
                    # The longest stretch of overlapping windows that all pass.
                    groups = np.split(good, np.flatnonzero(np.diff(good) > w) + 1)
                    g = max(groups, key=lambda x: x[-1] - x[0])
                    s, e = int(g[0]), int(g[-1]) + w
                    new = (s + a + diagonal, e + a + diagonal, int(same[e] - same[s]))
                    if item not in best or (new[2], -new[0]) > (best[item][2], -best[item][0]):
                        best[item] = new
        return best


def put(found: dict[int, list[np.ndarray]], item: np.ndarray, diagonal: np.ndarray) -> None:
    """Adds distinct diagonals to those of their items."""
    order = np.lexsort((diagonal, item))
    item, diagonal = item[order], diagonal[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1])
    item, diagonal = item[new], diagonal[new]
    starts = np.flatnonzero(np.diff(item, prepend=-1))
    for i, part in zip(item[starts], np.split(diagonal, starts[1:]), strict=True):
        found.setdefault(int(i), []).append(part)


def slices_of(benchmark: DataFrame, masks: tuple[str, ...], slice_mb: int, window: int, least: float) -> Iterator:
    """Broadcast indexes of the benchmark, each of at most about ``slice_mb`` of text."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    for i in range(n := -(-total // (slice_mb << 20))):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        part.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in part], masks, window, least))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, least: float = 0.8, masks: tuple[str, ...] = MASKS, slice_mb: int = 8) -> DataFrame:
    """Overlaps of ``docs`` (doc_id, text) with ``benchmark`` (item_id, text).

    One row for each row of ``docs`` and item that share ``window`` consecutive positions (or the
    whole item, if shorter) of which the share ``least`` agrees: doc_id, item_id, first_word,
    end_word (of the text, end exclusive), n_words, n_same. Words are runs of letters and digits in
    lower case. Windows and items of up to five words are found by masks of their own, except that
    an item of one word matches nothing, as it would match that word anywhere. Of several overlaps
    with an item that of most agreeing words is reported, of equal ones the first.

    Null and empty texts hold nothing; null ids are passed on; rows that repeat, in either table, are
    reported each; an empty benchmark or table gives no rows. Other columns are not read. Very long
    texts are compared whole, with memory in proportion to their length, also where words repeat.

    The benchmark goes to the executors in slices of at most about ``slice_mb`` of text, with one
    pass over ``docs`` for each, so no broadcast grows with it. Nothing is shuffled.
    """
    schema = "doc_id bigint, item_id bigint, first_word int, end_word int, n_words int, n_same int"
    found = docs.sparkSession.createDataFrame([], schema)
    for sent in slices_of(benchmark, masks, slice_mb, window, least):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                rows: list[tuple] = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if text:
                        rows += [(doc_id, index.ids[k], s, e, e - s, n) for k, (s, e, n) in sorted(index.overlaps(text, window, least).items())]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["doc_id", "item_id", "first_word", "end_word", "n_words", "n_same"])

        found = found.unionByName(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, least: float = 0.8, masks: tuple[str, ...] = MASKS, slice_mb: int = 8) -> DataFrame:
    """The rows of ``docs`` that have no overlap in the sense of :func:`contaminated`, with all their columns.

    Rows without text stay, as do those without id, if their text is clean; rows that repeat stay or
    go together. An empty benchmark drops nothing, an empty table gives an empty one, and columns of
    any name pass through.
    """
    for sent in slices_of(benchmark, masks, slice_mb, window, least):
        docs = keep_text(docs, lambda sent=sent: lambda texts: [not (t and sent.value.overlaps(t, window, least)) for t in texts])
    return docs
