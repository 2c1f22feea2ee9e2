"""Splitting texts into chunks: token budgets with built-in functions, character windows with a Pandas UDF."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T

BUDGET = 450
def halved(units: Column, limit: int) -> Column:
    """An array of arrays: ``units`` cut at n // 2 again and again until no piece is above ``limit``.

    A fold over as many rounds as the longest piece needs, whatever its length.
    """
    half = lambda w: F.floor(F.size(w) / 2).cast("int")
    cut = lambda w: F.when(F.size(w) > limit, F.array(F.slice(w, F.lit(1), half(w)), F.slice(w, half(w) + 1, F.size(w)))).otherwise(F.array(w))
    # One round more than the logarithm says costs little and makes up for its rounding.
    rounds = F.greatest(F.ceil(F.log2(F.size(units) / F.lit(float(limit)))), F.lit(0)).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(1), rounds), F.array(units), lambda pieces, _: F.flatten(F.transform(pieces, cut)))


def parts(text: Column, limit: int = BUDGET, tokenize: Callable[[Column], Column] = T.tokens) -> Column:
    """Sentences as struct(part, n): whole where they fit, else pieces of tokens joined by spaces."""
    cut = lambda s: F.transform(halved(tokenize(s), limit), lambda w: F.struct(F.array_join(w, " ").alias("part"), F.size(w).alias("n")))
    # Counted in a pass of its own, so that a sentence is taken apart once, not at every use of its length.
    counted = F.transform(T.sentences(text), lambda s: F.struct(s.alias("part"), (T.token_count(s) if tokenize is T.tokens else F.size(tokenize(s))).alias("n")))
    return F.flatten(F.transform(counted, lambda x: F.when(x["n"] > limit, cut(x["part"])).otherwise(F.array(x))))


def packed(pieces: Column, limit: int = BUDGET) -> Column:
    """Chunks as struct(chunk, n) of struct(part, n) pieces: greedy, in order, ``limit`` inclusive, no overlap.

    The fold keeps only the index at which each chunk starts, so it is linear in the pieces.
    """
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("k"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        flush = (acc["i"] == 0) | (acc["k"] + x["n"] > limit)
        return F.struct(
            F.when(flush, F.concat(acc["starts"], F.array(acc["i"] + 1))).otherwise(acc["starts"]).alias("starts"),
            F.when(flush, x["n"]).otherwise(acc["k"] + x["n"]).alias("k"),
            (acc["i"] + 1).alias("i"),
        )

    def spans(acc: Column) -> Column:
        ends = F.concat(F.slice(acc["starts"], F.lit(2), F.greatest(F.size(acc["starts"]) - 1, F.lit(0))), F.array(acc["i"] + 1))
        return F.arrays_zip(acc["starts"].alias("a"), ends.alias("b"))

    def chunk(s: Column) -> Column:
        own = F.slice(pieces, s["a"], s["b"] - s["a"])
        return F.struct(
            F.array_join(F.transform(own, lambda p: p["part"]), " ").alias("chunk"),
            F.aggregate(own, F.lit(0), lambda a, p: a + p["n"]).alias("n"),
        )

    return F.when(F.size(pieces) > 0, F.transform(F.aggregate(pieces, start, step, spans), chunk)).otherwise(F.array().cast("array<struct<chunk:string,n:int>>"))


#: Separators from the strongest to none.
SEPARATORS = ("\n\n", "\n", ".", "!", "?", ";", ",", " ", "")


def windows(text: str | None, size: int = 1200, overlap: int = 150) -> list[str]:
    """Overlapping windows of at most ``size`` characters, cut at the strongest separators that serve.

    A text is first taken apart into atoms: it is split before each occurrence of the strongest
    separator that occurs; what is still too long goes on with weaker ones. Neighbouring atoms of one
    split are joined while they fit; a new window starts with the last atoms of the one before that
    have ``overlap`` characters at most.
    """

    def pieces(t: str, seps: tuple[str, ...]) -> tuple[list[str], tuple[str, ...]]:
        at = next(i for i, s in enumerate(seps) if not s or s in t)
        sep = seps[at]
        if not sep:
            return list(t), ()
        head, *rest = t.split(sep)
        return [p for p in [head, *(sep + r for r in rest)] if p], seps[at + 1 :]

    def join(atoms: list[str]) -> list[str]:
        out, held, length = [], [], 0
        for a in atoms:
            if held and length + len(a) > size:
                out.append("".join(held))
                first = 0
                while first < len(held) and (length > overlap or length + len(a) > size):
                    length -= len(held[first])
                    first += 1
                held = held[first:]
            held.append(a)
            length += len(a)
        if held:
            out.append("".join(held))
        return [w for w in (x.strip() for x in out) if w]

    def walk(t: str, seps: tuple[str, ...]) -> list[str]:
        atoms, weaker = pieces(t, seps)
        out, small = [], []
        for a in atoms:
            if len(a) < size:
                small.append(a)
                continue
            out += join(small)
            small = []
            out += walk(a, weaker) if weaker else [x for x in [a.strip()] if x]
        return out + join(small)

    return walk(text, SEPARATORS) if text else []


def char_windows(text: Column, size: int = 1200, overlap: int = 150, splitter: Callable[[str | None, int, int], list[str]] = windows) -> Column:
    """Windows of each cleaned text and the error of the ``splitter``, as struct(windows, error).

    Null and empty texts have no windows; a text that the splitter fails on has none but its error,
    and fails nothing else. The function counts as nondeterministic: else the filter that an explode
    implies would be moved below it, and every text would be cut twice.
    """

    @F.pandas_udf("struct<windows:array<string>,error:string>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        found: list[list[str]] = []
        errors: list[str | None] = []
        for t in texts:
            try:
                found.append(splitter(t, size, overlap))
                errors.append(None)
            except Exception as e:  # noqa: BLE001  one bad text is one row with an error
                found.append([])
                errors.append(f"{type(e).__name__}: {e}")
        return pd.DataFrame({"windows": found, "error": errors})

    return cut.asNondeterministic()(text)
