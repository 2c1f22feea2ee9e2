"""The pipeline's entry points, each a function of DataFrames."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import documents as D
from quillspark.operators import rag, vectors
from quillspark.sources import docx, store

health = store.health
ingest = docx.scan
objects = store.objects
list_documents = D.listing
extract = docx.extract
pack_chunks = D.packed_chunks
embed = vectors.embed
embed_stats = vectors.embed_stats
store_vectors = store.store_vectors
ask = rag.ask


def redact(extracted: DataFrame, terms: list[str], keep: list[str] | None = None) -> DataFrame:
    """Extracted texts without the terms; rows with an error stay as they are."""
    return extracted.withColumn("text", D.redact(F.col("text"), terms, keep))


def embed_stage(chunks: DataFrame, path: str, **options: object) -> dict:
    """Embeds chunks into a table at ``path`` and returns the statistics with the seconds it took, to 2 digits."""
    start = time.perf_counter()
    store.write_stage(embed(store.with_defaults(chunks, {"chunk": F.lit("")}), **options), path)
    stats = embed_stats(chunks.sparkSession.read.parquet(path)).first().asDict()
    stats["time_taken_seconds"] = round(time.perf_counter() - start, 2)
    store.log.info("embedded %s chunks into %s", stats["total_chunks"], path)
    return stats


def run(spark: SparkSession, folder: str, work: str, terms: list[str]) -> dict:
    """All stages from files to vectors, each a table below ``work``."""
    store.write_stage(redact(extract(ingest(spark, folder)), terms), f"{work}/anonymized")
    texts = spark.read.parquet(f"{work}/anonymized").where("error IS NULL").withColumnRenamed("file_name", "source_file")
    store.write_stage(pack_chunks(texts), f"{work}/chunks")
    stats = embed_stage(spark.read.parquet(f"{work}/chunks"), f"{work}/embedded")
    return stats | store_vectors(spark.read.parquet(f"{work}/embedded"), f"{work}/vectors", once=True)
