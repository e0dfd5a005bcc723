"""Streamed stages 1 and 2: duplicates dropped and cancellations matched as invoice files arrive.

Every micro-batch of new files is one epoch.  Its lines lose rows without a customer and rows that an earlier epoch has (by the
stored hashes of earlier lines, a second hash guarding against collisions), and are stored as epoch ``n`` of the line table.  Only customers with new lines can get
other matches, so their lines alone are read back from all epochs, matched anew with the batch operators, and written as epoch
``n`` of the clean table together with the epoch's list of customers.  The current clean table has, for every customer, the
lines of the last epoch that touched them.

An epoch's output depends on its files and on earlier epochs only and is overwritten when the epoch runs again, so a retried batch changes
nothing.  ``compact`` folds the clean table's epochs into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillscope.operators import cancellation as C
from tillscope.operators.cleaning import dedup_lines
from tillscope.schema import INVOICE_COLUMNS
from tillscope.session import ensure_checkpoint_dir
from tillscope.sources.invoice_csv import read_invoices
from tillscope.sources.results import path_exists

#: Customers are spread over so many folders, so that an epoch reads the files of its customers' folders only.
SHARDS = 64


def _hashes() -> list:
    """Two hashes of a line's content; nulls count as a value of their own."""
    parts = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(c) for c in INVOICE_COLUMNS]))
    return [F.xxhash64(parts).alias("h1"), F.md5(parts).alias("h2")]


class CleanStream:
    """Line table, customer lists and clean table of a stream below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, strict: bool = False, shards: int = SHARDS):
        self.spark, self.base, self.strict, self.shards = spark, folder.rstrip("/"), strict, shards
        ensure_checkpoint_dir(spark)

    def _table(self, name: str, before: int | None = None) -> DataFrame | None:
        path = f"{self.base}/{name}"
        if not path_exists(self.spark, path):
            return None
        table = self.spark.read.parquet(path)
        return table if before is None else table.where(F.col("epoch") < before)

    def _write(self, df: DataFrame, name: str, epoch: int, by: str | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{self.base}/{name}/epoch={epoch}")

    def _shard(self):
        return F.pmod(F.xxhash64("CustomerID"), F.lit(self.shards)).cast("int")

    def land(self, lines: DataFrame, epoch: int) -> None:
        """One epoch: lines as read from its files."""
        new = dedup_lines(lines, key_in_data=False).withColumn("shard", self._shard())
        new = new.select("*", *_hashes())
        old = self._table("lines", epoch)
        if old is not None:
            # of the shards only hashes are read; one row per line, so no hot keys
            new = new.join(old.select("shard", "h1", "h2"), ["shard", "h1", "h2"], "left_anti")
        # earlier lines of a retried epoch are overwritten
        key = F.concat_ws(":", F.lpad(F.lit(str(epoch)), 12, "0"), "line_key")
        self._write(new.withColumn("line_key", key).hint("rebalance", "shard"), "lines", epoch, "shard")
        landed = self._table("lines", epoch + 1)
        touched = landed.where(F.col("epoch") == epoch).select("CustomerID", "shard").distinct().checkpoint(eager=True)
        self._write(touched.select("CustomerID", F.col("shard").alias("part")), "touched", epoch)
        shards = [r["shard"] for r in touched.select("shard").distinct().collect()]   # at most ``shards``
        theirs = landed.where(F.col("shard").isin(shards)).join(touched.select("CustomerID"), "CustomerID", "left_semi")
        theirs = theirs.select(*INVOICE_COLUMNS, "line_key").checkpoint(eager=True)
        self._write(C.clean_lines(theirs), "clean", epoch)

    def clean(self) -> DataFrame:
        """The current clean lines."""
        last = self._table("touched").groupBy("CustomerID").agg(F.max("epoch").alias("epoch"))
        return self._table("clean").join(last, ["CustomerID", "epoch"], "left_semi").drop("epoch")

    def compact(self, epoch: int) -> None:
        """Write the current clean lines as those of ``epoch``, the last one that ran, with the list of all customers."""
        current = self.clean().checkpoint(eager=True)
        everyone = self._table("touched").select("CustomerID", "part").distinct().checkpoint(eager=True)
        self._write(current, "clean", epoch)
        self._write(everyone, "touched", epoch)

    def start(self, upload_dir: str, checkpoint: str, files: int = 100, available_now: bool = True) -> StreamingQuery:
        """Follow the CSV files of ``upload_dir``, at most ``files`` of them per epoch.

        Files of one header are read together; broken records are left out of the lines (null values) instead of stopping the
        stream, unless the stream is ``strict``.
        """
        schema = self.spark.read.format("binaryFile").load(upload_dir).schema
        stream = (self.spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.csv")
                  .option("maxFilesPerTrigger", files).load(upload_dir).select("path"))

        def epoch(batch: DataFrame, number: int) -> None:
            paths = sorted(r["path"] for r in batch.select("path").collect())   # at most ``files``
            if paths:
                self.land(read_batch(self.spark, paths, self.strict), number)

        w = stream.writeStream.foreachBatch(epoch).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="3 seconds")).start()


def read_batch(spark: SparkSession, paths: list[str], strict: bool = False) -> DataFrame:
    """Invoice lines of many files: one read per distinct header, not per file."""
    from tillscope.sources.catalog import file_headers

    by_header: dict[tuple, list[str]] = {}
    for parts in file_headers(spark, paths).values():
        for path, names in parts:
            by_header.setdefault(tuple(names), []).append(path)
    out = None
    for files in by_header.values():
        one = read_invoices(spark, files, strict=strict, corrupt="FAILFAST" if strict else "PERMISSIVE")
        out = one if out is None else out.unionByName(one)
    return out
