"""The registered queries: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.operators import cancellation as C
from tillscope.operators import cleaning as D
from tillscope.operators import customers as U
from tillscope.operators import baskets as B
from tillscope.plans import oracle as O
from tillscope.plans.context import context
from tillscope.sources.results import MONTH

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# ---- stage 1 ----
@register("dedup_transactions", O.sql("SELECT * FROM dedup"))
def q_dedup(spark, sf):
    return context(spark, sf).dedup()


@register("ingest_summary", O.sql("""
SELECT (SELECT count(*) FROM tx WHERE CustomerID IS NOT NULL) - count(*) AS duplicate_rows,
  count(*) AS "rows", 8 AS cols FROM dedup"""))
def q_ingest_summary(spark, sf):
    c = context(spark, sf)
    return D.ingest_summary(c.raw(), c.dedup())


@register("product_list", O.sql("SELECT DISTINCT Description FROM dedup"))
def q_product_list(spark, sf):
    return D.product_list(context(spark, sf).dedup())


# ---- stage 2 ----
@register("cancellation_matches", O.sql("SELECT * FROM matches"))
def q_matches(spark, sf):
    return context(spark, sf).matches()


@register("unmatched_cancellations", O.sql("""
SELECT n.neg_key, n.CustomerID, n.StockCode, n.a AS AbsQuantity FROM neg n
WHERE n.neg_key NOT IN (SELECT neg_key FROM matches)"""))
def q_unmatched(spark, sf):
    c = context(spark, sf)
    return C.unmatched_cancellations(c.dedup(), c.matches())


@register("clean_transactions", O.sql("SELECT * FROM clean"))
def q_clean(spark, sf):
    return context(spark, sf).clean().drop(MONTH)


# ---- stage 4 ----
@register("basket_rollup", O.sql("SELECT * FROM baskets"))
def q_baskets(spark, sf):
    return context(spark, sf).baskets()


@register("basket_train_test_split", O.sql(f"""
SELECT *, CASE WHEN InvoiceDate < {O.CUT} THEN 'train' ELSE 'test' END AS part FROM baskets"""))
def q_split(spark, sf):
    c = context(spark, sf)
    tr, te = B.split_baskets(c.baskets(), c.p.cut_date)
    return tr.withColumn("part", F.lit("train")).unionByName(te.withColumn("part", F.lit("test")))


@register("basket_stats", O.sql(f"""
SELECT min(InvoiceDate) AS first_basket, max(InvoiceDate) AS last_basket,
  count(*) FILTER (WHERE InvoiceDate < {O.CUT}) AS train_rows,
  count(*) FILTER (WHERE InvoiceDate >= {O.CUT}) AS test_rows FROM baskets"""))
def q_basket_stats(spark, sf):
    c = context(spark, sf)
    return B.basket_stats(c.baskets(), c.p.cut_date)


@register("rfm_metrics", O.sql("SELECT CustomerID, Recency, Frequency, Monetary FROM rfm"))
def q_rfm(spark, sf):
    return context(spark, sf).segments().select("CustomerID", "Recency", "Frequency", "Monetary")


@register("rfm_scores", O.sql("""
SELECT CustomerID, Recency, Frequency, Monetary, R_Score, F_Score, M_Score, M_Pct FROM scored"""))
def q_rfm_scores(spark, sf):
    return context(spark, sf).segments().select(
        "CustomerID", "Recency", "Frequency", "Monetary", "R_Score", "F_Score", "M_Score", "M_Pct")


@register("customer_segments", O.sql("""
SELECT CustomerID, R_Score, F_Score, M_Score, M_Pct, RFM_Segment, cluster FROM segments"""))
def q_segments(spark, sf):
    return context(spark, sf).segments().select(
        "CustomerID", "R_Score", "F_Score", "M_Score", "M_Pct", "RFM_Segment", "cluster")


@register("customer_profile", O.sql("SELECT * FROM profile"))
def q_profile(spark, sf):
    return context(spark, sf).profile()


@register("segment_distribution", O.sql(
    'SELECT RFM_Segment, cluster, count(*) AS customers FROM segments GROUP BY RFM_Segment, cluster'))
def q_seg_dist(spark, sf):
    return U.segment_distribution(context(spark, sf).segments())


@register("rfm_scaled", O.sql("""
SELECT CustomerID, cluster,
  round((Recency - (SELECT avg(Recency) FROM segments)) / (SELECT stddev_pop(Recency) FROM segments), 6) AS z_Recency,
  round((Frequency - (SELECT avg(Frequency) FROM segments)) / (SELECT stddev_pop(Frequency) FROM segments), 6) AS z_Frequency,
  round((Monetary - (SELECT avg(Monetary) FROM segments)) / (SELECT stddev_pop(Monetary) FROM segments), 6) AS z_Monetary
FROM segments"""))
def q_rfm_scaled(spark, sf):
    z = U.standardized_rfm(context(spark, sf).segments())
    return z.select("CustomerID", "cluster", *[F.round(c, 6).alias(c) for c in ("z_Recency", "z_Frequency", "z_Monetary")])


@register("test_customer_profile", O.sql("SELECT * FROM test_prof"))
def q_test_profile(spark, sf):
    return context(spark, sf).test_profile()


@register("label_test_customers", O.sql("SELECT * FROM test_labels"))
def q_test_labels(spark, sf):
    c = context(spark, sf)
    return U.label_customers(c.test_profile().select("CustomerID"), c.segments(), c.p.default_label)


# ---- silhouette of the rule segments (squared Euclidean, standardised R, F, M) ----
def _seg_silhouette(c):
    from tillscope.operators.silhouette import silhouette
    z = U.standardized_rfm(c.segments())
    return silhouette(z, ["z_Recency", "z_Frequency", "z_Monetary"])


@register("segment_silhouette", O.sql("SELECT round(silhouette, 6) AS silhouette FROM sil"))
def q_seg_sil(spark, sf):
    return _seg_silhouette(context(spark, sf)).select(F.round("silhouette", 6).alias("silhouette"))


# ---- report layer ----
from tillscope.operators import reports as R  # noqa: E402

for _name, _period in (("kpi_overview_last30", None), ("kpi_overview_month", O.P_MONTH),
                       ("kpi_overview_year", O.P_YEAR)):
    def _kpi(spark, sf, _p=_period):
        return R.kpi_overview(context(spark, sf).clean(), _p)
    register(_name, O.kpi_sql(_period))(_kpi)


@register("region_share", O.region_sql(None))
def q_region(spark, sf):
    return R.region_share(context(spark, sf).clean(), None)


@register("region_cumulative_share", O.region_cum_sql(None))
def q_region_cum(spark, sf):
    clean = context(spark, sf).clean()
    cur, _ = R.period_masks(clean, None)
    members = clean.filter(cur).agg(F.countDistinct("CustomerID")).scalar()
    return R.region_cumulative_share(R.region_share(clean, None), members)


@register("premium_members", O.premium_sql(None))
def q_premium(spark, sf):
    return R.premium_member_list(context(spark, sf).clean(), None)


@register("daily_sales", O.daily_sql(None))
def q_daily(spark, sf):
    return R.daily_sales(context(spark, sf).clean(), None)


@register("monthly_sales", O.monthly_sql(O.P_YEAR))
def q_monthly(spark, sf):
    return R.monthly_sales(context(spark, sf).clean(), O.P_YEAR)


@register("available_periods", O.sql("""
SELECT DISTINCT strftime(InvoiceDate, '%Y-%m') AS period, 'month' AS kind FROM clean
UNION ALL SELECT DISTINCT strftime(InvoiceDate, '%Y') AS period, 'year' AS kind FROM clean""", "clean"))
def q_periods(spark, sf):
    return R.available_periods(context(spark, sf).clean())


@register("repeat_interval", O.sql(
    "SELECT coalesce(CAST(trunc(avg(gap)) AS BIGINT), 0) AS repeat_days FROM rep_gap"))
def q_repeat(spark, sf):
    return R.repeat_interval(context(spark, sf).clean())


# ---- the same questions from the monthly partial aggregates ----
@register("kpi_overview_year_from_months", O.kpi_sql(O.P_YEAR))
def q_kpi_months(spark, sf):
    return R.kpi_overview(context(spark, sf).monthly().orders(), O.P_YEAR)


@register("segment_trend_from_months", O.segment_trend_sql(O.P_YEAR))
def q_seg_trend_months(spark, sf):
    c = context(spark, sf)
    return R.segment_trend(c.profile(), c.monthly().orders(), O.P_YEAR)


@register("product_cluster_summary_from_months", O.product_summary_sql(O.P_MONTH))
def q_prod_months(spark, sf):
    c = context(spark, sf)
    return R.product_cluster_summary(c.stand_in_map(), None, O.P_MONTH, stats=c.monthly().product_stats(O.P_MONTH))


@register("monthly_sales_from_months", O.monthly_sql(O.P_YEAR))
def q_sales_months(spark, sf):
    return context(spark, sf).monthly().monthly_sales(O.P_YEAR)


@register("upload_preview_periods", O.sql(
    "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period FROM orders WHERE o_orderdate IS NOT NULL"))
def q_preview(spark, sf):
    from tillscope.sources.driver_tables import read_table
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy H:mm")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return R.upload_preview_periods(read_table(spark, sf, "orders").select(text.alias("Invoice_Date")))


@register("segment_summary", O.segment_summary_sql(None))
def q_seg_summary(spark, sf):
    c = context(spark, sf)
    return R.segment_summary(c.profile(), c.clean(), None)


@register("segment_trend", O.segment_trend_sql(O.P_YEAR))
def q_seg_trend(spark, sf):
    c = context(spark, sf)
    return R.segment_trend(c.profile(), c.clean(), O.P_YEAR)


@register("segment_focus_category", O.segment_focus_sql(None))
def q_seg_focus(spark, sf):
    c = context(spark, sf)
    return R.segment_focus_category(c.profile(), c.clean(), None)


@register("segment_headline", O.segment_headline_sql(None))
def q_seg_headline(spark, sf):
    c = context(spark, sf)
    return R.segment_headline(c.profile(), c.clean(), None, c.test(), _seg_silhouette(c))


@register("product_cluster_summary", O.product_summary_sql(None))
def q_prod_summary(spark, sf):
    c = context(spark, sf)
    return R.product_cluster_summary(c.stand_in_map(), c.clean(), None)


@register("product_cluster_relative_share", O.sql(
    "SELECT id, share, round(share / max(share) OVER () * 100, 1) AS relative_share FROM (" + O.product_summary_sql(None) + ") z"))
def q_prod_relative(spark, sf):
    return R.relative_to_largest(q_prod_summary(spark, sf)).select("id", "share", "relative_share")


@register("product_cluster_names", O.sql("SELECT id, name FROM (" + O.product_summary_sql(None) + ") z"))
def q_prod_names(spark, sf):
    return q_prod_summary(spark, sf).select("id", "name")


@register("cluster_sample_products", O.sql("SELECT ClusterID, rank, Description FROM smp"))
def q_samples(spark, sf):
    return R.cluster_sample_products(context(spark, sf).stand_in_map()
                                     .select("Description", F.col("categ_product").alias("ClusterID")))


@register("keyword_cloud", O.sql("""
SELECT keyword, name AS cluster, id, k FROM (
  SELECT id, name, unnest(keywords) AS keyword, unnest(range(0, len(keywords))) AS k FROM (
""" + O.product_summary_sql(None) + """) z) u ORDER BY id, k LIMIT 10"""))
def q_keyword_cloud(spark, sf):
    return R.keyword_cloud(q_prod_summary(spark, sf))


# ---- stage 3: products ----
from tillscope.operators import products as PR  # noqa: E402


def _prods(c):
    return c.cached("products", lambda: PR.products(c.clean()))


def _keywords(c):
    return c.cached("product_keywords", lambda: PR.product_keywords(_prods(c)))


def product_groups(c):
    """KMeans product groups (the default product map of the stage chain)."""
    def build():
        feats = PR.product_features(_prods(c), _keywords(c))
        mapping, model, sil, seed = PR.cluster_products(feats, c.p.n_product_clusters, c.p.silhouette_floor,
                                                        c.p.max_cluster_attempts)
        c.p.extra["product_silhouette"] = sil
        return mapping.withColumn("silhouette", F.lit(sil)).withColumn("seed", F.lit(seed))
    return c.cached("product_groups", build, checkpoint=True)


@register("product_keywords", O.sql("SELECT * FROM kws"))
def q_keywords(spark, sf):
    return _keywords(context(spark, sf))


@register("product_price_bands", O.sql("SELECT * FROM bands"))
def q_bands(spark, sf):
    return PR.price_bands(_prods(context(spark, sf)))


@register("product_keyword_matrix", O.sql("""
SELECT DISTINCT p.Description, p.t0 AS keyword FROM ptok p JOIN kws k ON p.t0 = k.keyword"""))
def q_kw_matrix(spark, sf):
    c = context(spark, sf)
    return PR.keyword_matrix(_prods(c), _keywords(c))


@register("product_clusters")
def q_product_clusters(spark, sf):
    return product_groups(context(spark, sf))


# ---- sources and sinks ----
from tillscope.session import work_path  # noqa: E402
from tillscope.sources import catalog as CAT  # noqa: E402
from tillscope.sources import exports as EXP  # noqa: E402
from tillscope.sources import invoice_csv as CSV  # noqa: E402
from tillscope.sources.driver_tables import read_table, transactions  # noqa: E402


@register("ingest_transactions", O.sql("SELECT * FROM tx"))
def q_ingest(spark, sf):
    """Adapter view -> Latin-1 CSV in the shared work folder -> strict read back."""
    path = work_path(spark, "invoices-csv")
    CSV.write_invoices(transactions(spark, sf), path)
    return CSV.read_invoices(spark, path, strict=True, has_line_key=True)


def _orders_text(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select(*[F.col(c).cast("string").alias(c) for c in o.columns])


_ORDERS_TEXT = ("SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in
                ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
                + " FROM orders")
_DATE_RX = [(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "%Y-%m-%d %H:%M:%S"),
            (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "%Y-%m-%d %H:%M"), (r"^\d{4}-\d{2}-\d{2}$", "%Y-%m-%d"),
            (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "%m/%d/%Y %H:%M"),
            (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "%m/%d/%Y %H:%M:%S")]


def _parse_sql(c):
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{rx}') THEN try_strptime({c}, '{f}')" for rx, f in _DATE_RX) + " END"


def _label_sql(c):
    num = f"TRY_CAST({c} AS DOUBLE)"
    whole = f"max(({num} - floor({num}))) <= 1e-8"
    return f"""SELECT '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 'text'
  WHEN count({_parse_sql(c)}) = count({c}) THEN 'datetime'
  WHEN count(*) FILTER (WHERE {c} IN ('True', 'False')) = count({c}) THEN 'int'
  WHEN count({num}) = count({c}) THEN CASE WHEN {whole} THEN 'int' ELSE 'float' END
  WHEN max(length({c})) <= 255 THEN 'varchar' ELSE 'text' END AS label FROM ot"""


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
O.cte("ot", _ORDERS_TEXT)
O.cte("olabels", " UNION ALL ".join(
    f"SELECT {i} AS position, * FROM ({_label_sql(c)})" for i, c in enumerate(_ORDER_COLS)))


@register("infer_column_types", O.sql('SELECT CAST(position AS INTEGER) AS position, "column", label FROM olabels'))
def q_infer(spark, sf):
    return CAT.infer_column_types(_orders_text(spark, sf))


@register("cast_by_inferred_type", O.sql("""
SELECT TRY_CAST(TRY_CAST(o_orderkey AS DOUBLE) AS BIGINT) AS o_orderkey,
  TRY_CAST(TRY_CAST(o_custkey AS DOUBLE) AS BIGINT) AS o_custkey, o_orderstatus,
  TRY_CAST(o_totalprice AS DOUBLE) AS o_totalprice, """ + _parse_sql("o_orderdate") + """ AS o_orderdate,
  o_orderpriority FROM ot"""))
def q_cast(spark, sf):
    df = _orders_text(spark, sf)
    labels = {r["column"]: r["label"] for r in CAT.infer_column_types(df).collect()}
    return CAT.cast_by_labels(df, labels)


@register("load_results_catalog", O.sql(f"""
SELECT 'stage_4_customers_train' AS table_name, (SELECT count(*) FROM profile) AS rows, {len(O.PROFILE_COLUMNS)}::INTEGER AS columns
UNION ALL SELECT 'stage4_set_test', (SELECT count(*) FROM test), {len(O.BASKET_COLUMNS)}::INTEGER
UNION ALL SELECT 'keywords', (SELECT count(*) FROM kws), 2::INTEGER""", "profile", "test", "kws"))
def q_catalog(spark, sf):
    c = context(spark, sf)
    folder = work_path(spark, "results")
    c.profile().write.mode("overwrite").option("header", True).csv(f"{folder}/Stage 4--Customers (train).csv")
    c.test().write.mode("overwrite").option("header", True).csv(f"{folder}/stage4_set_test.csv")
    _keywords(c).write.mode("overwrite").option("header", True).csv(f"{folder}/stage3/keywords.csv")
    return CAT.load_results(spark, folder, work_path(spark, "tables")).drop("source")   # paths differ on every run


@register("export_product_cluster", O.sql("SELECT Description, categ_product AS ClusterID FROM pmap WHERE categ_product = 0"))
def q_export_products(spark, sf):
    return EXP.product_group_members(context(spark, sf).stand_in_map(), 0)


@register("export_segment", O.sql(
    f"SELECT * FROM ({O.seg_sel_sql(O.P_YEAR)}) s WHERE cluster = 3", "profile", "clean"))
def q_export_segment(spark, sf):
    c = context(spark, sf)
    return EXP.segment_members(c.profile(), c.clean(), 3, O.P_YEAR)


# ---- stages 5-7: models and explanations (rows-only checks) ----
import json  # noqa: E402

from tillscope.operators import models as M  # noqa: E402
from tillscope.operators import shapley as SH  # noqa: E402
from tillscope.plans import model_stages as MS  # noqa: E402
from tillscope.schema import FEATURE_COLS  # noqa: E402

ML_GRID = "full"   # registered queries search the reference's grids, as pipelines do by default


def ml_split(c, grid: str = ML_GRID) -> dict:
    """Split (and the labelled later-period rows) without fitting anything."""
    st = c.p.extra.setdefault(f"ml_{grid}", {})
    if "split" not in st:
        st["split"] = MS.split_profile(c.profile(), c.p, M.GRIDS[grid]["folds"])
        st["later"] = MS.later_rows(c.test_profile(), c.segments(), c.p)
    return st


def ml_state(c, grid: str = ML_GRID, names: tuple[str, ...] = M.FAMILIES) -> dict:
    """The split and the fitted families ``names`` (a family is fitted when it is first asked for)."""
    st = ml_split(c, grid)
    fitted = st.setdefault("fitted", {})
    missing = tuple(n for n in names if n not in fitted)
    if missing:
        fitted.update(M.fit_suite(st["split"], grid, c.p.seed, names=missing))
    if {"RF", "GB", "KNN"} <= set(fitted):
        fitted["VOTE"] = M.vote(fitted)
    return st


def ml_eval(c) -> tuple[DataFrame, DataFrame]:
    st = ml_state(c)
    if "eval" not in st:
        st["eval"] = MS.evaluate_periods(st["fitted"], st["split"], st["later"])
    return st["eval"]


def ml_shap(c) -> tuple[DataFrame, DataFrame]:
    st = ml_state(c, names=MS.EXPLAINED_FAMILIES)
    if "shap" not in st:
        st["shap"] = MS.explain_models(st["fitted"], st["split"], st["later"], c.p)
    return st["shap"]


_SPLIT_SQL = """
WITH b AS (SELECT *, cluster AS label, row_number() OVER (PARTITION BY cluster ORDER BY md5(CustomerID::VARCHAR || '42'), CustomerID) - 1 AS rank
  FROM profile),
n AS (SELECT label, count(*) * 0.8 AS share, floor(count(*) * 0.8 + 1e-9) AS whole, count(*) AS n FROM b GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY round(whole - share, 9), label) AS turn,
  floor(sum(n) OVER () * 0.8 + 1e-9) - sum(whole) OVER () AS spare FROM n),
s AS (SELECT b.*, CASE WHEN rank < whole + (CASE WHEN turn <= spare THEN 1 ELSE 0 END) THEN 'train' ELSE 'test' END AS part
  FROM b JOIN o USING (label))
"""


@register("stratified_split", O.sql(
    "SELECT * FROM (" + _SPLIT_SQL + f"SELECT CustomerID, label::INTEGER AS label, part, (rank % {M.GRIDS[ML_GRID]['folds']})::INTEGER AS fold FROM s) z", "profile"))
def q_split_strat(spark, sf):
    return ml_split(context(spark, sf))["split"].select("CustomerID", F.col("label").cast("int").alias("label"), "part", "fold")


@register("training_features", O.sql(
    "SELECT * FROM (" + _SPLIT_SQL + "SELECT CustomerID, " + ", ".join(f'"{f}"' for f in FEATURE_COLS)
    + " FROM s WHERE part = 'train') z", "profile"))
def q_train_features(spark, sf):
    return ml_split(context(spark, sf))["split"].where(F.col("part") == "train").select("CustomerID", *FEATURE_COLS)


@register("model_grid_search")
def q_grid(spark, sf):
    fitted = ml_state(context(spark, sf))["fitted"]   # all families
    rows = [(n, json.dumps({k: (float(v) if isinstance(v, float) else v) for k, v in sorted(f.params.items())}),
             f.cv_accuracy) for n, f in sorted(fitted.items()) if n != "VOTE"]
    return spark.createDataFrame(rows, "model string, best_params string, cv_accuracy double")


@register("model_eval")
def q_model_eval(spark, sf):
    return ml_eval(context(spark, sf))[0]


@register("model_predictions")
def q_model_pred(spark, sf):
    return ml_eval(context(spark, sf))[1]


@register("shap_importance")
def q_shap_imp(spark, sf):
    return ml_shap(context(spark, sf))[0]


@register("shap_values")
def q_shap_vals(spark, sf):
    return ml_shap(context(spark, sf))[1]


@register("shap_values_sample")
def q_shap_sample(spark, sf):
    from pyspark.sql import Window
    c = context(spark, sf)
    v = ml_shap(c)[1]
    w = Window.partitionBy("model").orderBy(F.xxhash64("CustomerID", F.lit(c.p.seed)), "CustomerID")
    return v.withColumn("n", F.row_number().over(w)).where(F.col("n") <= c.p.shap_sample_rows).drop("n")


@register("shap_importance_relative")
def q_shap_rel(spark, sf):
    return SH.relative_importance(ml_shap(context(spark, sf))[0])


@register("explained_model_accuracy")
def q_explained_acc(spark, sf):
    st = ml_state(context(spark, sf), names=MS.EXPLAINED_FAMILIES)
    if "explained" not in st:
        st["explained"] = MS.explained_accuracy(st["fitted"], st["later"])
    return st["explained"]
