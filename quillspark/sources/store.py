"""Text and JSON sources, stage tables and the vector store."""

from __future__ import annotations

import logging
import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.vectors import storable

#: The one logger of the engine; it has no handler of its own.
log = logging.getLogger("quillspark")

CHUNK_SCHEMA = "source_file string, chunk string, embedding array<float>, metadata string"


def setting(name: str, default: str | None = None) -> str:
    """An environment variable; missing without default, or empty where one is required, is an error."""
    value = os.environ.get(name, default)
    if value is None or (default is None and value == ""):
        raise RuntimeError(f"{name} is not set")
    return value


def health(spark: SparkSession) -> dict:
    return {"ok": True, "user": spark.sql("SELECT current_user() AS u").first()["u"]}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local one where that is unset and the master is local too."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    have = sc._jsc.sc().getCheckpointDir()
    if not have.isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        have = sc._jsc.sc().getCheckpointDir()
    return have.get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate files below :func:`shared_dir`, which goes when the application ends."""
    path = f"{shared_dir(spark)}/quillspark-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def objects(spark: SparkSession, uri: str) -> DataFrame:
    """What an object store or file system holds below ``uri``: path, key (relative), length and modified.

    Any store that Spark reads; all pages of a listing. Contents are not read; ``binaryFile`` reads
    those that are wanted, so nothing has to be downloaded first.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(uri)
    # The common root as the file system writes it, with scheme.
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).resolvePath(at).toString().rstrip("/") + "/"
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "file:/")
    key = F.substring(plain(F.col("path")), F.length(plain(F.lit(root))) + 1, F.length("path"))
    return found.select("path", key.alias("key"), "length", F.col("modificationTime").alias("modified"))


def put_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes ``content`` (binary) of each row as the file ``key`` below ``folder``, and returns key, length and error.

    Executors write, each file under another name first, so that a task that runs again leaves no
    half of one. Nothing is written until the result is read. ``folder`` is a path or a URI that
    pyarrow knows (file, s3, gs, hdfs) and all executors reach.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            errors: list[str | None] = []
            for key, content in zip(pdf["key"], pdf["content"], strict=True):
                try:
                    path = f"{root.rstrip('/')}/{key}"
                    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    part = f"{path}.{uuid.uuid4().hex}.part"
                    with files.open_output_stream(part) as out:
                        out.write(content)
                    files.move(part, path)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one file that fails is one row with an error
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"key": pdf["key"], "length": [len(c) for c in pdf["content"]], "error": errors})

    return files.select("key", "content").mapInPandas(run, "key string, length bigint, error string")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """source_file and text of the ``.txt`` files right in ``folder``, stripped, without blank ones."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("source_file"), T.strip(F.col("value")).alias("text"))
    return rows.where(F.col("text") != "")


def read_json(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """Rows of a JSON array, by a given schema."""
    return spark.read.json(path, schema=schema, multiLine=True)


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``rows`` with a default where a column is null or, as a key that no row has, missing."""
    have = {c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()}
    return rows.withColumns(have)


def chunk_defaults() -> dict[str, Column]:
    """What the keys of a chunk count as where they are missing."""
    return {"chunk": F.lit(""), "embedding": F.array().cast("array<float>"), "metadata": F.lit("{}")}


def write_stage(df: DataFrame, path: str) -> None:
    """A stage's table; it replaces the one before."""
    df.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """The vector store: vec_id, chunk, embedding and metadata, and ``more`` columns that were written with them."""
    return spark.read.parquet(path).select("vec_id", "chunk", "embedding", "metadata", *more)


def insert_one(spark: SparkSession, path: str, chunk: str, vector: list[float], metadata: dict | None = None) -> int:
    """Appends one chunk with its vector to the store and returns its id."""
    import json

    row = spark.createDataFrame([(chunk, [float(x) for x in vector], json.dumps(metadata or {}))], "chunk string, embedding array<float>, metadata string")
    row = row.withColumn("vec_id", F.xxhash64("chunk", "metadata"))
    row.write.mode("append").parquet(path)
    return row.first()["vec_id"]


def store_vectors(embedded: DataFrame, path: str, once: bool = False, dims: int | None = None) -> dict[str, int]:
    """Appends rows with a vector to the store and counts inserted and skipped rows in the same pass.

    Metadata keeps the source and the chunk's number. With ``once``, rows whose content is in the
    store already, or is repeated, are left out, so that a rerun adds nothing. With ``dims``, a
    vector of another length is an error, and nothing is stored.
    """
    spark = embedded.sparkSession
    has = F.coalesce(F.size("embedding"), F.lit(0)) > 0
    seen = Observation()
    watched = embedded.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(has).alias("valid"))
    known = [c for c in ("source_file", "chunk_index") if c in embedded.columns]
    meta = F.to_json(F.struct(*known)) if known else F.lit("{}")
    vector = F.col("embedding").cast("array<float>")
    if dims is not None:
        vector = F.when(F.size(vector) == dims, vector).otherwise(F.raise_error(F.concat(F.lit(f"a vector doesn't have {dims} dimensions but "), F.size(vector).cast("string"))).cast("array<float>"))
    rows = storable(watched).select("chunk", vector.alias("embedding"), meta.alias("metadata"))
    rows = rows.withColumn("vec_id", F.xxhash64("chunk", "metadata"))
    inserted = Observation()
    if once:
        rows = rows.dropDuplicates(["vec_id"])
        try:
            have = spark.read.parquet(path).select("vec_id")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            have = None
        if have is not None:
            rows = rows.join(have, "vec_id", "left_anti")
    rows.observe(inserted, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    log.info("stored %s vectors in %s", inserted.get["n"], path)
    return {"inserted": inserted.get["n"], "skipped": seen.get["total"] - seen.get["valid"], "total": seen.get["total"]}


def export_texts(df: DataFrame, folder: str) -> DataFrame:
    """Writes the text of each row without error as the file ``file_name`` + ``.txt``, and returns file_name and error.

    Rows of one name overwrite each other. Nothing is written until the result is read.
    """
    good = df.where(F.col("error").isNull() & F.col("text").isNotNull())
    done = put_files(good.select(F.concat("file_name", F.lit(".txt")).alias("key"), F.col("text").cast("binary").alias("content")), folder)
    return done.select(F.expr("left(key, length(key) - 4)").alias("file_name"), "error")
