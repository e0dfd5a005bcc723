"""Invoice CSV source and sink (Latin-1, header row)."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.schema import INVOICE_COLUMNS, INVOICE_CSV_SCHEMA

_TIME = r"(?:[T ]+(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d*)?(?: ?([AaPp])[Mm])?)?"
# ---- fixed values: accepted invoice-date layouts and the groups that hold year, month and day; a time may follow ----
DATE_LAYOUTS = [
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})" + _TIME + "$", (1, 2, 3)),
    (r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})" + _TIME + "$", (3, 1, 2)),
]


def parse_invoice_date(c: Column, strict: bool = True) -> Column:
    """TIMESTAMP_NTZ from text: year-month-day or month/day/year, then, if wanted, hours and minutes with seconds, a fraction
    or AM / PM, after blanks or a T.

    strict: an unparseable value (a 13th month, too) fails the job; otherwise it becomes null.
    """
    parsed = F.lit(None).cast("timestamp_ntz")
    plain = c.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")   # the layout that needs no taking apart
    for rx, (y, m, d) in DATE_LAYOUTS:
        part = lambda i, rx=rx: F.regexp_extract(c, rx, i)
        two = lambda x: F.lpad(x, 2, "0")
        hour = F.when(part(4) == "", F.lit("00")).when(part(7) == "", two(part(4))).when(
            part(4).try_cast("int").between(1, 12), two((part(4).try_cast("int") % 12 + F.when(F.lower(part(7)) == "p", 12).otherwise(0)).cast("string")))
        clock = F.concat_ws(":", hour, F.when(part(5) == "", F.lit("00")).otherwise(part(5)), F.when(part(6) == "", F.lit("00")).otherwise(part(6)))
        text = F.when(hour.isNotNull(), F.concat(part(y), F.lit("-"), two(part(m)), F.lit("-"), two(part(d)), F.lit(" "), clock))
        parsed = F.when(c.rlike(rx), text.try_cast("timestamp_ntz")).otherwise(parsed)
    parsed = F.when(plain, c.try_cast("timestamp_ntz")).otherwise(parsed)
    if strict:   # parsed once: only a value without a result is looked at again
        return F.coalesce(parsed, F.when(c.isNotNull(), F.raise_error(F.concat(F.lit("unparseable InvoiceDate: "), c)).cast("timestamp_ntz")))
    return parsed


def _column_of(names: list[str]) -> dict[str, str]:
    """Invoice column -> column of the file, by name without case, spaces and underscores."""
    plain = {n.lower().replace("_", "").replace(" ", "").lstrip("\ufeff").replace("ï»¿", ""): n for n in reversed(names)}
    missing = [c for c in INVOICE_COLUMNS if c.lower() not in plain]
    if missing:
        raise ValueError(f"invoice file has no column {', '.join(missing)}")
    return {c: plain[c.lower()] for c in INVOICE_COLUMNS}


def files_with_long_records(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[str]]:
    """(files in which every record ends with its line, files with records that span lines): a line with an odd number of
    quotes opens or closes such a record.  One row per file reaches the driver."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    odd = F.max((quotes % 2).cast("int"))
    lines = spark.read.option("encoding", "ISO-8859-1").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    rows = sorted((unquote(r["file"]), r["odd"]) for r in lines.groupBy("file").agg(odd.alias("odd")).collect())
    return [f for f, o in rows if not o], [f for f, o in rows if o]


def read_invoices(spark: SparkSession, path: str | list[str], strict: bool = True, has_line_key: bool = False,
                  corrupt: str = "FAILFAST") -> DataFrame:
    """Read invoice lines by header name; further columns are ignored and quoted values may hold line breaks.

    Files are split over tasks by blocks, except those in which a record spans lines (each of them is one task).  Without a
    ``line_key`` column in the file one is made from file order, so later stages never rely on row position.  A missing path, a
    missing column or a file of another layout than the first fails the job; ``corrupt`` is the reader's mode for broken records.
    """
    options = {"header": True, "encoding": "ISO-8859-1", "mode": corrupt, "escape": '"'}
    path = [unquote(p) for p in path] if isinstance(path, list) else path
    short, long = files_with_long_records(spark, path)
    out = None
    for files, lines in ((short, False), (long, True)):
        if not files:
            continue
        # lines end as in the text reader that looked for long records
        some = spark.read.options(**options, multiLine=lines)
        names = some.csv(files).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = some.schema(schema).options(enforceSchema=False).csv(files)
        of, types = _column_of(names), {f.name: f.dataType for f in INVOICE_CSV_SCHEMA.fields}
        cols = [(F.col(f"`{of[c]}`").cast(types[c]) if corrupt == "FAILFAST" else F.col(f"`{of[c]}`").try_cast(types[c])).alias(c)
                for c in INVOICE_COLUMNS]
        if has_line_key:
            key = F.col("line_key")
        else:
            key = F.concat_ws(":", F.col("_metadata.file_name"),
                              F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"),
                              F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
        one = raw.select(*cols, key.alias("line_key"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"no lines in {path}")
    return out.withColumn("InvoiceDate", parse_invoice_date(F.col("InvoiceDate"), strict))


def write_invoices(df: DataFrame, path: str) -> None:
    """Write lines as a Latin-1 CSV with an ISO date text."""
    out = df.withColumn("InvoiceDate", F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss"))
    (out.write.mode("overwrite").option("header", True).option("encoding", "ISO-8859-1").option("escape", '"')
        .csv(path))
