"""Incremental ingest of invoice CSV drops (the upload step) with Structured Streaming.

New files in an upload folder arrive as a stream of paths; the files of one header are read together (Latin-1), broken values
become null, and each micro-batch is written as one ``epoch=<id>`` partition of the raw line table (overwrite of that partition, so a retried batch is idempotent).  The
months seen in each batch are kept in a second table for the upload preview.  The
batch stages (dedup, cancellation match, ...) then read the raw table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillscope.streaming.clean_stream import read_batch


def _land(table_path: str, months_path: str):
    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        paths = sorted(r["path"] for r in batch.select("path").collect())   # at most ``files`` of one batch
        if not paths:
            return
        lines = read_batch(spark, paths)
        lines.write.mode("overwrite").parquet(f"{table_path}/epoch={epoch}")
        (lines.select(F.date_format("InvoiceDate", "yyyy-MM").alias("period")).where("period IS NOT NULL")
         .distinct().write.mode("overwrite").parquet(f"{months_path}/epoch={epoch}"))
    return handle


def start_upload_ingest(spark: SparkSession, upload_dir: str, table_path: str, months_path: str,
                        checkpoint_path: str, available_now: bool = True, files: int = 100) -> StreamingQuery:
    """Land the CSV files of ``upload_dir``, at most ``files`` of them per batch."""
    schema = spark.read.format("binaryFile").load(upload_dir).schema
    stream = (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.csv")
              .option("maxFilesPerTrigger", files).load(upload_dir).select("path"))
    w = stream.writeStream.foreachBatch(_land(table_path, months_path)).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="3 seconds")
    return w.start()


def read_landed(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.parquet(table_path).drop("epoch")
