"""Spooled external documents: JSON files in a folder, one document each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import text_type
from tidemark.sources.storage import file_system

SCHEMA = "doc_id string, url string, text string, content_type string, fetched_ns bigint, broken string"
MOST_TEXT, MOST_FILE, FILES = 1 << 20, 8 << 20, 1000


def accepted(rows: DataFrame) -> DataFrame:
    """rows with `path` and `reason`, why a document is refused, null for the accepted ones."""
    text = F.col("text")
    reason = (
        F.when(F.col("_metadata.file_size") > MOST_FILE, "file too large").when(F.col("broken").isNotNull(), "not JSON").when(text.isNull() | (F.trim(F.regexp_replace(text, r"\s", "")) == ""), "no text")
        .when(F.octet_length(text) > MOST_TEXT, "too long").when(~text_type(F.coalesce("content_type", F.lit(""))), "not text")
    )
    return rows.withColumn("path", F.col("_metadata.file_path")).withColumn("reason", reason)


def options(reader, schema: str = SCHEMA):
    return reader.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "broken").option("pathGlobFilter", "*.json")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all *.json files in a folder."""
    return accepted(options(spark.read).json(path))


def watch(spark: SparkSession, path: str, files: int = FILES) -> DataFrame:
    """A stream of the documents that are there and those to come, at most `files` a batch; no file is touched."""
    return accepted(options(spark.readStream.option("maxFilesPerTrigger", files)).json(path))


def ingest(spark: SparkSession, path: str, to: str, checkpoint: str, files: int = FILES, once: bool = False) -> StreamingQuery:
    """Moves the accepted documents of a folder into a table: each batch is written to `to`/batch=n, overwritten if it is run again,
    and only then its accepted files are deleted, at most `files` of them. Refused files stay where they are."""

    def take(batch: DataFrame, n: int) -> None:
        good = batch.where("reason IS NULL").drop("reason", "broken")
        good.write.mode("overwrite").parquet(f"{to}/batch={n}")
        for r in spark.read.schema(good.schema).parquet(f"{to}/batch={n}").select("path").distinct().collect():
            fs, at = file_system(spark, r.path)
            fs.delete(at, False)

    writer = watch(spark, path, files).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
