"""Sharding by jump consistent hashing.

A key and the number of shards decide the shard; no ring table is kept. When a shard is appended,
only the rows that it takes move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut

#: Hexadecimal digits of a row's hash that name its bucket.
DIGITS = 3


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: the last jump below ``shards``."""
    if shards < 1:
        raise ValueError("there has to be a shard")
    state, at = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    last = at.copy()
    live = np.arange(len(keys))
    while len(live):
        last[live] = at[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        scale = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        at[live] = ((last[live] + 1) * scale).astype(np.int64)
        live = live[at[live] < shards]
    return last


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key of eight bytes, read as a whole number with its first byte highest."""

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(np.frombuffer(b"".join(keys), ">u8"), shards))

    return number(key)


def stable_key(doc_id: Column) -> Column:
    """The key of a document: the first eight bytes of its id's md5. Documents without id share the key of an empty one."""
    return F.unhex(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 16))


def add_shard(docs: DataFrame, shards: int, name: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row by its doc_id; a column of that name is replaced. No shuffle.

    Rows that repeat an id go together, whatever their texts, which aren't read; rows without id go
    to one shard. An empty table gives an empty one.
    """
    return docs.withColumn(name, shard_of(stable_key(F.col("doc_id")), shards))


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """Shards and slots of ``docs`` (doc_id, text).

    Returns doc_id, size (UTF-8 bytes of the text plus 1; 1 if null), text_crc32 (of the UTF-8
    bytes; a null text counts as empty), law (``key``), shard (0 to ``shards`` - 1), slot (its
    number in the shard, from 0 without gaps) and grown_shard (with one shard more). Rows without
    doc_id go to one shard; rows that repeat go together but have slots of their own. Slots follow
    the md5 of id and checksum; where rows tie in that, they are equal in all that is returned. An
    empty table gives an empty one. Other columns are not read.

    Texts are read once: ids, sizes and checksums are written, and numbered from there. Slots are
    numbered within buckets of a shard and shifted by the rows in earlier buckets; the table of those
    shifts has 16 to the power ``DIGITS`` rows a shard at most, whatever the data.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = stable_key(F.col("doc_id"))
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("text_crc32").cast("string"))
    rows = cut(rows.select("*", shard_of(key, shards).alias("shard"), shard_of(key, shards + 1).alias("grown_shard"), F.md5(own.cast("binary")).alias("h")), "sizes")
    rows = rows.withColumn("bucket", F.substring("h", 1, DIGITS))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("number", number).join(F.broadcast(shift), ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("shift") + F.col("number")).cast("bigint").alias("slot"), "grown_shard")
