"""Relational operators over loaded documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import chunks as C
from quillspark.functions import text as T


def listing(docs: DataFrame) -> DataFrame:
    """file, folder and path of loaded documents; the text is pruned from the scan."""
    return docs.select(F.col("file_name").alias("file"), "folder", F.col("file_path").alias("path"))


def with_suffix(files: DataFrame, suffix: str, name: str = "file_name", ignore_case: bool = True) -> DataFrame:
    """Files with a suffix that are no lock files (``~$...``)."""
    own = F.lower(name) if ignore_case else F.col(name)
    return files.where(own.endswith(suffix) & ~F.col(name).startswith("~$"))


def without_folders(objects: DataFrame, key: str = "key") -> DataFrame:
    """Objects of a listing that are no folders: keys ending in a slash go."""
    return objects.where(~F.col(key).endswith("/"))


def latest_by_name(files: DataFrame, name: str, order: str) -> DataFrame:
    """One row a name: the one that comes last by ``order``. Aggregated before it is shuffled."""
    rest = [c for c in files.columns if c != name]
    picked = files.groupBy(name).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return picked.select(name, *(F.col("__row")[c].alias(c) for c in rest))


def attempt(docs: DataFrame, value: Callable[[Column], Column], column: str = "text") -> DataFrame:
    """``docs`` with the value and a null error, or an error and no value where the input is null or blank."""
    error = F.when(T.is_blank(F.col(column)), F.lit("no text"))
    return docs.withColumn("error", error).withColumn(column, F.when(F.col("error").isNull(), value(F.col(column))))


def packed_chunks(docs: DataFrame, source: str = "source_file", text: str = "text", limit: int = C.BUDGET, tokenize: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """Chunks of a token budget: ``source``, chunk_index (from 0), chunk and n_tokens. Narrow: nothing is shuffled."""
    pieces = docs.select(source, C.parts(F.col(text), limit, tokenize).alias("__parts"))
    spread = pieces.select(source, F.posexplode(C.packed(F.col("__parts"), limit)).alias("chunk_index", "__c"))
    return spread.select(source, "chunk_index", F.col("__c.chunk").alias("chunk"), F.col("__c.n").alias("n_tokens"))


def char_chunks(
    docs: DataFrame,
    path: str = "file_path",
    text: str = "text",
    size: int = 1200,
    overlap: int = 150,
    entities: Callable[[Column], Column] | None = T.entities,
    splitter: Callable[[str | None, int, int], list[str]] = C.windows,
) -> DataFrame:
    """Overlapping chunks of cleaned texts with their sensitive terms and metadata.

    A document that can't be split is one row with its error and no chunk; others are not affected.
    Blank documents have no rows. ``entities`` recognises names in a chunk; None leaves them out.
    """
    cut = docs.select(path, C.char_windows(T.clean_text(F.col(text)), size, overlap, splitter).alias("__w"))
    # An error stands for a window, so that its row outlives the explode.
    shown = F.when(F.col("__w.error").isNull(), F.col("__w.windows")).otherwise(F.array(F.lit(None).cast("string")))
    spread = cut.select(path, F.size("__w.windows").alias("__n"), F.col("__w.error").alias("error"), F.posexplode(shown).alias("chunk_index", "text"))
    found = entities(F.col("text")) if entities else None
    return spread.select(
        path,
        F.when(F.col("error").isNull(), F.col("chunk_index")).alias("chunk_index"),
        "text",
        T.sensitive_terms(F.col("text"), found).alias("sensitive_terms"),
        F.struct(T.base_name(F.col(path).cast("string")).alias("source"), F.length("text").alias("chunk_length"), F.col("__n").alias("total_chunks")).alias("metadata"),
        "error",
    )


def context(hits: DataFrame, key: str, order: str, chunk: str = "chunk", separator: str = "\n\n") -> DataFrame:
    """One string a key: the chunks in order, joined by a blank line."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(chunk).alias("c"))))
    return hits.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["c"]), separator).alias("context"))


def preview(docs: DataFrame, order: str = "file_name") -> DataFrame:
    """The first document by name; none of an empty collection."""
    return docs.orderBy(order).limit(1)


def redact(text: Column, terms: list[str], keep: list[str] | None = None, placeholder: str = "[REDACTED]") -> Column:
    """Replaces ``terms`` in any case, also inside identifiers, but for those allowed; all else stays as it is.

    Longer terms go first. The terms are a dictionary of the caller's, part of the plan.
    """
    import re

    allowed = {k.lower() for k in keep or []}
    use = sorted({t for t in terms if t and t.lower() not in allowed}, key=lambda t: (-len(t), t))
    if not use:
        return text
    return F.regexp_replace(text, "(?i)" + "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in use), placeholder.replace("$", r"\$"))


def metadata(text: Column) -> Column:
    """JSON text as a map; null, empty and broken text as an empty one."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def vector_literal(vector: Column) -> Column:
    """A vector as ``[a,b,...]``."""
    return F.to_json(vector)

