"""Stage 1: drop lines without a customer, count and drop full-row duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.schema import INVOICE_COLUMNS


def dedup_lines(lines: DataFrame, key_in_data: bool = True) -> DataFrame:
    """Lines with a customer, each distinct row once.

    key_in_data: ``line_key`` is part of the row content (driver tables), so plain
    ``dropDuplicates`` over all columns.  Otherwise (CSV) rows are equal on the invoice
    columns and the earliest file position is kept as the key.  Both are hash
    aggregates with a map-side partial step, so a heavily copied row collapses before
    the shuffle.
    """
    kept = lines.dropna(subset=["CustomerID"])
    if key_in_data:
        return kept.dropDuplicates()
    return kept.groupBy(*INVOICE_COLUMNS).agg(F.min("line_key").alias("line_key"))


def ingest_summary(lines: DataFrame, deduped: DataFrame) -> DataFrame:
    """One row: duplicate_rows, rows, cols (invoice columns, the key not counted)."""
    n_in = lines.dropna(subset=["CustomerID"]).agg(F.count(F.lit(1))).scalar()
    return (deduped.agg(F.count(F.lit(1)).alias("rows"))
            .select((n_in - F.col("rows")).alias("duplicate_rows"), "rows",
                    F.lit(len(INVOICE_COLUMNS)).alias("cols")))


def product_list(lines: DataFrame) -> DataFrame:
    """Distinct descriptions of the de-duplicated lines, null included."""
    return lines.select("Description").distinct()
