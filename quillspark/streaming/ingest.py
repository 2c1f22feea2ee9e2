"""The pipeline's narrow stages over a stream of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions import text as T
from quillspark.operators.documents import packed_chunks
from quillspark.operators.vectors import embed


def stream_texts(spark: SparkSession, folder: str) -> DataFrame:
    """New ``.txt`` files as rows of source_file and text."""
    rows = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").load(folder)
    return rows.select(F.col("_metadata.file_name").alias("source_file"), T.strip(F.col("value")).alias("text")).where("text != ''")


def chunk_and_embed(texts: DataFrame) -> DataFrame:
    """Stateless, so that append mode needs no watermark."""
    return embed(packed_chunks(texts))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to a Parquet table and stops."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
