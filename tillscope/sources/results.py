"""Result sinks: stage tables, metrics and fitted models."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.timecols import month_label
from tillscope.operators.boosting import Boosted, Stumps
from tillscope.operators.cleaning import dedup_lines
from tillscope.operators.forests import Forest
from tillscope.operators.linear import LinearFit
from tillscope.operators.models import Fitted, vote
from tillscope.schema import FEATURE_COLS
from tillscope.session import LINE_TABLES, held


def save_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """Write each table under ``folder/<name>`` (parquet, or csv with a header)."""
    paths = []
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        w = df.write.mode("overwrite")
        (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
        paths.append(path)
    return paths


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table's path exists, in whatever store it is."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return True
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()):
            return False
        raise


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read back: a stage hand-off that survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MONTH = "invoice_month"
#: Codec of the line tables, the largest that the chain writes.
CODEC = "zstd"
#: Partitions that the shuffle of whole lines has at least; those of little data are coalesced.
WIDE_PARTS = 200
#: Lines that a task takes of a month at most, about, where they are counted beforehand (``deal``).
TASK_LINES = 200_000
#: Column of rows that are dealt out: the number of their task.
DEAL = "_deal"


def write_by_month(df: DataFrame, path: str, date: str = "InvoiceDate", laid_out: bool = False) -> DataFrame:
    """Write a line table as Parquet partitioned by the month of ``date`` and read it back, so that period questions
    prune partitions and columns.  Rebalancing keeps files whole and splits hot months; lines that come from files by month
    (``laid_out``) are written where they are."""
    out = df.withColumn(MONTH, month_label(date))
    with held(df.sparkSession, LINE_TABLES if laid_out else {}):
        (out if laid_out else out.hint("rebalance", MONTH)).write.mode("overwrite").partitionBy(MONTH).parquet(path, compression=CODEC)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def deal(rows: DataFrame, date: str, name: str, counted: DataFrame) -> DataFrame:
    """``rows`` shuffled into tasks of about ``TASK_LINES`` rows of one month of ``date``, or of some smaller ones, with the number of
    the task as ``DEAL``; a larger month is split by a hash of ``name``.  ``counted`` has the dates of the rows (or a few more).

    For rows of which lines are yet to be made (``distinct_by_month`` takes those where they are): equal lines must be of equal
    ``date`` and ``name``.  Only the numbers and names that lines are made of are shuffled, not their longer texts.
    """
    spark = rows.sparkSession
    month = F.coalesce(F.year(date) * 12 + F.month(date), F.lit(0)).cast("int")
    sizes = counted.groupBy(month.alias("_month")).count().collect()   # a row per month
    most = max(1, min(TASK_LINES, -(-sum(r["count"] for r in sizes) // spark.sparkContext.defaultParallelism)))
    plan, task, filled = [], 0, 0
    for r in sorted(sizes):
        if filled and filled + r["count"] > most:
            task, filled = task + 1, 0
        parts = -(-r["count"] // most)
        plan.append((r["_month"], task, parts))
        task, filled = (task + parts, 0) if parts > 1 else (task, filled + r["count"])
    tasks = task + (1 if filled or not plan else 0)
    plan = F.broadcast(spark.createDataFrame(plan, "_month int, _first int, _parts int"))
    return (rows.withColumn("_month", month).join(plan, "_month")
            .withColumn(DEAL, F.col("_first") + F.pmod(F.xxhash64(name), F.col("_parts")).cast("int"))
            .drop("_month", "_first", "_parts").repartitionById(tasks, DEAL))


def distinct_by_month(lines: DataFrame, path: str, key_in_data: bool = True, date: str = "InvoiceDate") -> DataFrame:
    """De-duplicated lines (``cleaning.dedup_lines``) written as Parquet by month and read back.

    One shuffle does both: equal lines are of one month and part, so they meet in a task, and a task writes few months.  A task
    holds its distinct lines, so there are many partitions to begin with, whatever the session's width.  Lines made of rows from
    ``deal`` are not shuffled again.
    """
    spark, initial = lines.sparkSession, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    wide = max(WIDE_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(initial, None) or 0))
    conf = {initial: wide}
    if DEAL in lines.columns:
        spread, conf = lines, conf | LINE_TABLES
    else:
        names = [c for c in lines.columns if key_in_data or c != "line_key"]
        parts = max(4, wide // 8)   # of a month
        spread = (lines.dropna(subset=["CustomerID"]).withColumn(MONTH, month_label(date))
                  .withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(parts))).repartition(MONTH, "_part"))
        if not key_in_data:
            spread = spread.drop(MONTH, "_part")
    out = dedup_lines(spread, key_in_data).drop("_part", DEAL)
    out = out if MONTH in out.columns else out.withColumn(MONTH, month_label(date))
    with held(spark, conf):
        out.write.mode("overwrite").partitionBy(MONTH).parquet(path, compression=CODEC)
    return spark.read.schema(out.schema).parquet(path).drop(MONTH)


def save_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    """One-row JSON metrics file (values as written, nested dicts kept)."""
    spark.createDataFrame([(json.dumps(metrics),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str) -> dict | None:
    """The metrics written by ``save_metrics``; None where there is no such path.  A broken file is an error."""
    try:
        files = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()):
            return None   # the section is absent
        raise
    row = files.first()
    if row is None:
        raise ValueError(f"no metrics in {path}")
    return json.loads(row["value"])


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Stage tables written by ``save_tables`` as Parquet."""
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in names}


_TABLES = {"forest": Forest, "logistic": LinearFit, "margin": LinearFit, "boost": Boosted, "ada": Stumps}


def save_models(spark: SparkSession, fitted: dict[str, Fitted], folder: str) -> dict[str, str]:
    """Persist the families as tables (nodes, weights, the KNN's training rows) and an index of them."""
    base, out, index = folder.rstrip("/"), {}, []
    for name, f in fitted.items():
        path = f"{base}/{name}"
        entry = {"name": name, "kind": f.kind, "params": f.params, "cv_accuracy": f.cv_accuracy, "joined": f.joined}
        if f.kind in _TABLES:
            spark.createDataFrame(f.model.rows(), type(f.model).SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
        elif f.kind == "knn":
            f.train.write.mode("overwrite").parquet(path)
        else:
            continue
        index.append(entry)
        out[name] = path
    save_metrics(spark, {"models": index}, f"{base}/index")
    return out


def load_models(spark: SparkSession, folder: str) -> dict[str, Fitted]:
    """Families saved by ``save_models``; the vote is rebuilt from its members.  A folder without an index is an error."""
    base, out = folder.rstrip("/"), {}
    index = read_metrics(spark, f"{base}/index")
    if index is None:
        raise FileNotFoundError(f"no saved models in {base}")
    for e in index["models"]:
        path = f"{base}/{e['name']}"
        f = Fitted(e["name"], e["kind"], params=e["params"], cv_accuracy=e["cv_accuracy"], joined=e["joined"])
        if e["kind"] == "knn":
            f.train = spark.read.parquet(path)
        elif e["kind"] == "boost":
            f.model = Boosted.from_rows(spark.read.parquet(path).collect(), len(FEATURE_COLS))
        else:
            f.model = _TABLES[e["kind"]].from_rows(spark.read.parquet(path).collect())
        out[e["name"]] = f
    if {"RF", "GB", "KNN"} <= set(out):
        out["VOTE"] = vote(out)
    return out
