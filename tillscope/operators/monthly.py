"""Partial aggregates per month for the report questions, kept up to date by load.

Three tables, a folder per load and month: (month, customer, invoice) with sales, lines, first and last time; (month,
description) with price sum and number, quantity and cancelled quantity; (month, day, country) with sales and lines.  A load
recomputes only the months in which a clean line came, went or changed its cancelled quantity (months of new lines and of
purchases that they cancel), from those months of the clean table; the last load of a month holds.  Questions by year and month
read these tables alone: ``orders()`` has the columns of the clean lines that the report functions use, so they run on it as
they do on the lines.  A load that runs again overwrites its own folder, so it can be retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.timecols import DAY_US, micros, month_label
from tillscope.sources.results import MONTH, path_exists

TABLES = ("orders", "products", "days")


def changed_months(before: DataFrame | None, after: DataFrame) -> list[str]:
    """Months in which clean lines differ between two states (or parts of states), by key and cancelled quantity."""
    rows = lambda df, side: df.select(month_label("InvoiceDate").alias(MONTH), "line_key", "QuantityCanceled", F.lit(side).alias("side"))
    both = rows(after, 1) if before is None else rows(after, 1).unionByName(rows(before, -1))
    # a line that is the same on both sides adds up to nothing; keys are unique on a side
    odd = both.groupBy(MONTH, "line_key", "QuantityCanceled").agg(F.sum("side").alias("side")).where("side <> 0")
    return sorted(r[MONTH] for r in odd.select(MONTH).distinct().collect())   # some hundred at most


def partials(clean: DataFrame) -> dict[str, DataFrame]:
    """The three partial aggregates of clean lines."""
    lines = clean if MONTH in clean.columns else clean.withColumn(MONTH, month_label("InvoiceDate"))
    return {
        "orders": lines.groupBy(MONTH, "CustomerID", "InvoiceNo").agg(
            F.sum("TotalPrice").alias("TotalPrice"), F.count(F.lit(1)).alias("lines"), F.min("InvoiceDate").alias("first"),
            F.max("InvoiceDate").alias("InvoiceDate")),
        "products": lines.groupBy(MONTH, "Description").agg(
            F.sum("UnitPrice").alias("price_sum"), F.count("UnitPrice").alias("price_n"), F.sum("Quantity").alias("Quantity"),
            F.sum("QuantityCanceled").alias("QuantityCanceled")),
        "days": lines.groupBy(MONTH, F.date_format("InvoiceDate", "yyyy-MM-dd").alias("day"), "Country").agg(
            F.sum("TotalPrice").alias("TotalPrice"), F.count(F.lit(1)).alias("lines")),
    }


class MonthlyState:
    """The partial aggregates below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.base = spark, folder.rstrip("/")

    def load(self, clean: DataFrame, load: int, months: list[str] | None = None) -> list[str]:
        """Recompute ``months`` (None: all) from the clean lines as load number ``load``; returns the months."""
        at = F.col(MONTH) if MONTH in clean.columns else month_label("InvoiceDate")
        rows = clean if months is None else clean.where(at.isin(months))   # prunes month partitions
        for name, part in partials(rows).items():
            part.write.mode("overwrite").partitionBy(MONTH).parquet(f"{self.base}/{name}/load={load}")
        months = months if months is not None else sorted(r[0] for r in rows.select(at).distinct().collect())
        self.spark.createDataFrame([(m,) for m in months], "month string").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/months/load={load}")
        return months

    def _last(self) -> dict[int, list[str]]:
        """{load: months that it holds}."""
        if not path_exists(self.spark, f"{self.base}/months"):
            return {}
        rows = self.spark.read.parquet(f"{self.base}/months").groupBy("month").agg(F.max("load").alias("load")).collect()   # a row per month
        out: dict[int, list[str]] = {}
        for r in rows:
            out.setdefault(r["load"], []).append(r["month"])
        return out

    def _table(self, name: str, period: str | None = None) -> DataFrame:
        """Current rows; ``period`` (a year, a month or a list of them) prunes month folders."""
        wanted = [period] if isinstance(period, str) else period
        last = {n: [m for m in ms if not wanted or any(m.startswith(p) for p in wanted)] for n, ms in self._last().items()}
        table = self.spark.read.schema(self._schema(name)).parquet(f"{self.base}/{name}")
        keep = F.lit(False)
        for n, ms in sorted(last.items()):
            if ms:
                keep = keep | ((F.col("load") == n) & F.col(MONTH).isin(sorted(ms)))
        return table.where(keep).drop("load")

    def _schema(self, name: str) -> str:
        cols = {"orders": "CustomerID string, InvoiceNo string, TotalPrice double, lines long, first timestamp_ntz, InvoiceDate timestamp_ntz",
                "products": "Description string, price_sum double, price_n long, Quantity long, QuantityCanceled long",
                "days": "day string, Country string, TotalPrice double, lines long"}[name]
        return f"{cols}, load int, {MONTH} string"

    def orders(self) -> DataFrame:
        """A row per month, customer and invoice, with the columns that the KPI, trend and segment questions take from the clean
        lines (InvoiceDate is the invoice's last line of the month)."""
        return self._table("orders")

    def product_stats(self, period: str | None) -> DataFrame:
        """As ``reports.product_stats``: mean unit price, quantity and cancelled quantity per description."""
        return self._table("products", period).groupBy("Description").agg(
            (F.sum("price_sum") / F.sum("price_n")).alias("UnitPrice"), F.sum("Quantity").alias("Quantity"),
            F.sum("QuantityCanceled").alias("QuantityCanceled"))

    def daily_sales(self, period: str) -> DataFrame:
        return self._table("days", period).groupBy("day").agg(F.sum("TotalPrice").cast("bigint").alias("value"))

    def monthly_sales(self, year: str) -> DataFrame:
        return self.daily_sales(year).groupBy(F.substring("day", 1, 7).alias("month")).agg(F.sum("value").alias("value"))

    def region_share(self, period: str, top: int = 4) -> DataFrame:
        rows = self._table("days", period).where("Country IS NOT NULL").groupBy("Country").agg(F.sum("lines").alias("lines"))
        total = rows.agg(F.sum("lines")).scalar()
        return (rows.withColumn("pct", F.round(F.col("lines") / total * 100, 1)).orderBy(F.desc("lines"), F.asc("Country")).limit(top)
                .select(F.col("Country").alias("name"), "pct", "lines"))

    def repeat_interval(self) -> DataFrame:
        per = (self._table("orders").groupBy("CustomerID")
               .agg(F.min(micros("first")).alias("lo"), F.max(micros("InvoiceDate")).alias("hi"), F.sum("lines").alias("n"))
               .where("n > 1").select((F.floor((F.col("hi") - F.col("lo")) / F.lit(DAY_US)) / (F.col("n") - 1)).alias("gap")))
        return per.agg(F.coalesce(F.avg("gap").cast("bigint"), F.lit(0).cast("bigint")).alias("repeat_days"))
