"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.store import scratch

#: A word for shingles, seeds and statistics: a run of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: So many texts at a time become Python objects.
STEP = 512


def few_files(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` dealt out to fewer partitions if it has at most ``rows`` rows, each with 50,000 at least.

    The rows are shuffled for that, so the stage that makes them keeps all its tasks.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is None or (parts := max(1, -(-rows // 50_000))) >= most:
        return df
    return df.repartition(parts)


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _written(df: DataFrame, name: str, rows: int | None) -> tuple[str, DataFrame]:
    path = scratch(df.sparkSession, name)
    few_files(df, rows).write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str = "stage", rows: int | None = None) -> DataFrame:
    """Writes ``df`` to a table in the shared folder and reads it again.

    What follows then depends on files that outlive any executor, and is computed once. The table
    goes when the application ends. ``rows``, an upper bound of the rows, spares small tables from
    being written as hundreds of files.
    """
    return _written(df, name, rows)[1]


class Tables:
    """Tables as :func:`cut` makes them, which can be dropped before the application ends."""

    def __init__(self) -> None:
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __call__(self, df: DataFrame, name: str = "stage", rows: int | None = None) -> DataFrame:
        path, table = _written(df, name, rows)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables; nothing that is still to be computed may need them."""
        for table in tables:
            if table is not None:
                files, at = _path(table.sparkSession, self.paths.pop(id(table))[1])
                files.delete(at, True)


class Held:
    """Intermediate tables on the executors' disks, until they are released.

    They keep their lineage, so what a lost executor held is computed again.
    """

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        self.tables.append(few_files(df, rows).persist(StorageLevel.DISK_ONLY))
        return self.tables[-1]

    def release(self) -> None:
        for df in self.tables:
            df.unpersist()
        self.tables.clear()


def map_text(
    rows: DataFrame,
    keep: list[str],
    make: Callable[[], Callable[[list], list[list]]],
    fields: list[tuple[str, str, pa.DataType]],
    text: str = "text",
    sieve: tuple[Sieve, str] | None = None,
) -> DataFrame:
    """Adds to the columns ``keep`` those that a Python function makes of each whole text.

    ``make`` runs once a task and returns a function from a list of texts (str or None) to one list
    for each of ``fields`` (name, Spark type, Arrow type). Arrow batches in, Arrow batches out, and
    columns that are kept never become Python objects. With a ``sieve`` and a column, only rows are
    returned whose value there may be wanted, in the same pass, so that one Python process does both.
    """
    test, bit = (sieve[0].test(), [sieve[0].bit(sieve[1]).alias("__bit")]) if sieve else (None, [])
    source = rows.select(*keep, text, *bit)
    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema]
    schema = ", ".join(ddl + [f"`{n}` {t}" for n, t, _ in fields])
    names, n = [*keep, *(f[0] for f in fields)], len(keep)
    kinds = [f[2] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        kept = (b.filter(pa.array(test(b.column(n + 1).to_numpy()))) for b in batches) if test else batches
        for b in (b.slice(at, STEP) for b in kept for at in range(0, b.num_rows, STEP)):
            made = work(b.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(n)), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))],
                names=names,
            )

    return source.mapInArrow(run, schema)


def keep_text(rows: DataFrame, make: Callable[[], Callable[[list], list[bool]]], text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose whole text a Python function keeps; no shuffle."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP)):
            yield b.filter(pa.array(work(b.column(at).to_pylist()), pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


class Sieve:
    """Tells values that may be in the one column of ``wanted``: all that are, and few others.

    A Bloom filter of one hash with at most ``bits`` bits, whatever the number of keys: its words are
    put together where the keys are. It spares a join rows; once full, it spares none.
    """

    def __init__(self, wanted: DataFrame, bits: int = 1 << 24) -> None:
        self.bits = bits
        words = wanted.select(self.bit(wanted.columns[0]).alias("bit")).select(F.expr("CAST(bit DIV 64 AS INT) AS w"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT)) AS b"))
        table = np.zeros(bits // 64, np.int64)
        got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
        table[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
        self.sent = wanted.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def bit(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column)), F.lit(self.bits))

    def test(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from bits, as :meth:`bit` makes them, to whether their values may be wanted."""
        sent = self.sent
        return lambda at: (sent.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def may_hold(self, column: str) -> Column:
        """Whether a value may be wanted; false for null."""
        test = self.test()

        @F.pandas_udf("boolean")
        def look_up(at: pd.Series) -> pd.Series:
            return pd.Series(test(at.to_numpy(np.int64)))

        return F.col(column).isNotNull() & look_up(self.bit(column))


class Hashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    LIMIT = 1 << 17

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str, known: Hashes) -> np.ndarray:
    """Hashes of the lower-cased words of a text, in order."""
    words = WORD.findall(text.lower())
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
