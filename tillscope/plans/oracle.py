"""DuckDB twins of the registered queries (the correctness oracle).

Each query is a chain of named CTEs over the driver's pre-registered views; ``sql``
pulls in the CTEs a final SELECT needs, in dependency order.  Habits: integers are
truncated with ``trunc`` before a cast (Spark casts truncate), mean times are integer
microseconds, doubles are written with explicit casts (a bare ``2.0`` is DECIMAL).
"""

from __future__ import annotations

import re

CUT = "TIMESTAMP '2000-10-01 00:00:00'"
DAY = "86400000000"

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def sql(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in re.findall(r"\b([a-z_0-9]+)\b", CTES[n]):
            if dep in CTES and dep != n:
                visit(dep)
        order.append(n)

    for n in needs:
        visit(n)
    for dep in re.findall(r"\b([a-z_0-9]+)\b", final):
        if dep in CTES:
            visit(dep)
    if not order:
        return final.strip()
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order) + "\n" + final.strip()


cte("tx_base", """
SELECT CAST(o_orderkey AS VARCHAR) AS InvoiceNo,
  CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'D' ELSE p_name || '-' || p_type END AS StockCode,
  CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'Discount' ELSE p_name || ' ' || lower(p_type) END AS Description,
  CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT) AS Quantity,
  l_shipdate AS InvoiceDate,
  CAST(p_size AS DOUBLE) / 4 AS UnitPrice,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS CustomerID,
  n_name AS Country,
  concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
            CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR),
            CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS line_key
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
cte("tx", "SELECT * FROM tx_base UNION ALL SELECT * FROM tx_base WHERE CAST(InvoiceNo AS BIGINT) % 97 = 0")
cte("dedup", "SELECT DISTINCT * FROM tx WHERE CustomerID IS NOT NULL")
cte("neg", """
SELECT line_key AS neg_key, CustomerID, StockCode, InvoiceDate AS t, -Quantity AS a
FROM dedup WHERE Quantity < 0 AND Description IS DISTINCT FROM 'Discount'""")
cte("pos", "SELECT line_key AS pos_key, CustomerID, StockCode, InvoiceDate AS t, Quantity AS q FROM dedup WHERE Quantity > 0")
cte("pairs", """
SELECT n.neg_key, p.pos_key, n.CustomerID, n.StockCode, n.a AS AbsQuantity,
  epoch_us(n.t) AS neg_time_us, epoch_us(p.t) AS pos_time_us,
  row_number() OVER (PARTITION BY n.neg_key ORDER BY p.t DESC, p.pos_key) AS rn
FROM neg n JOIN pos p ON n.CustomerID = p.CustomerID AND n.StockCode IS NOT DISTINCT FROM p.StockCode
  AND p.t < n.t AND p.q >= n.a""")
cte("matches", "SELECT * EXCLUDE (rn) FROM pairs WHERE rn = 1")
cte("canceled", "SELECT pos_key, arg_max(AbsQuantity, neg_key) AS qc FROM matches GROUP BY pos_key")
cte("clean", """
SELECT d.*, CAST(coalesce(c.qc, 0) AS BIGINT) AS QuantityCanceled,
  d.UnitPrice * CAST(d.Quantity - coalesce(c.qc, 0) AS DOUBLE) AS TotalPrice
FROM dedup d LEFT JOIN canceled c ON d.line_key = c.pos_key
WHERE d.Quantity IS NULL OR d.Quantity >= 0 OR (d.Description = 'Discount' AND d.StockCode = 'D')""")
cte("pmap", """
SELECT DISTINCT Description, CAST(length(Description) % 5 AS INTEGER) AS categ_product
FROM clean WHERE Description IS NOT NULL""")
cte("lines_c", """
SELECT c.*, coalesce(m.categ_product, -1) AS categ_product FROM clean c LEFT JOIN pmap m ON c.Description = m.Description""")
_categ = ",\n  ".join(
    f"sum(CASE WHEN categ_product = {i} THEN greatest(TotalPrice, CAST(0 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END) AS categ_{i}"
    for i in range(5))
cte("baskets", f"""
SELECT CustomerID, InvoiceNo, sum(TotalPrice) AS basket_price,
  make_timestamp(CAST(sum(CAST(epoch_us(InvoiceDate) AS HUGEINT)) // count(*) AS BIGINT)) AS InvoiceDate,
  {_categ}
FROM lines_c GROUP BY CustomerID, InvoiceNo HAVING sum(TotalPrice) > 0""")
cte("train", f"SELECT * FROM baskets WHERE InvoiceDate < {CUT}")
cte("test", f"SELECT * FROM baskets WHERE InvoiceDate >= {CUT}")
_csum = ", ".join(f"sum(categ_{i}) AS s{i}" for i in range(5))
cte("roll", f"""
SELECT CustomerID, count(*) AS "count", min(basket_price) AS "min", max(basket_price) AS "max",
  avg(basket_price) AS "mean", sum(basket_price) AS "sum", max(epoch_us(InvoiceDate)) AS last_us, {_csum}
FROM train GROUP BY CustomerID""")
_cpct = ",\n  ".join(f'CASE WHEN "sum" = 0 THEN CAST(0 AS DOUBLE) ELSE s{i} / "sum" * 100 END AS categ_{i}' for i in range(5))
cte("rfm", f"""
SELECT CustomerID, "count", "min", "max", "mean", "sum", last_us,
  {_cpct},
  CAST(((SELECT max(epoch_us(InvoiceDate)) FROM train) + {DAY} - last_us) // {DAY} AS BIGINT) AS Recency,
  "count" AS Frequency, "sum" AS Monetary
FROM roll""")
cte("edges", """
SELECT quantile_cont(Recency, [0.25, 0.5, 0.75]) AS q, count(*) AS n FROM rfm""")
cte("ranked", """
SELECT rfm.*, row_number() OVER (ORDER BY Frequency, CustomerID) AS f_pos,
  row_number() OVER (ORDER BY Monetary, CustomerID) AS m_pos FROM rfm""")
cte("mties", "SELECT Monetary, CAST(min(m_pos) + max(m_pos) AS DOUBLE) / 2 AS m_avg FROM ranked GROUP BY Monetary")


def _first_q(col: str) -> str:
    e = [f"(1 + CAST(e.n - 1 AS DOUBLE) * {k} / 4)" for k in (1, 2, 3)]
    return (f"CASE WHEN {col} <= {e[0]} THEN 1.0 WHEN {col} <= {e[1]} THEN 2.0 "
            f"WHEN {col} <= {e[2]} THEN 3.0 ELSE 4.0 END")


cte("scored", f"""
SELECT r.* EXCLUDE (f_pos, m_pos),
  CAST(CASE WHEN Recency <= e.q[1] THEN 4.0 WHEN Recency <= e.q[2] THEN 3.0 WHEN Recency <= e.q[3] THEN 2.0 ELSE 1.0 END AS DOUBLE) AS R_Score,
  CAST({_first_q('f_pos')} AS DOUBLE) AS F_Score,
  CAST({_first_q('m_pos')} AS DOUBLE) AS M_Score,
  t.m_avg / CAST(e.n AS DOUBLE) AS M_Pct
FROM ranked r CROSS JOIN edges e JOIN mties t ON r.Monetary = t.Monetary""")
SEGMENT_SQL = """CASE WHEN M_Pct >= 0.95 THEN 'Champions'
  WHEN R_Score = 4 AND F_Score = 4 AND M_Score >= 3 THEN 'Champions'
  WHEN R_Score >= 3 AND F_Score >= 3 AND M_Score >= 3 THEN 'Loyal Customers'
  WHEN R_Score = 1 AND (F_Score >= 3 OR M_Score >= 3) THEN 'At Risk'
  WHEN R_Score = 1 AND F_Score <= 2 AND M_Score <= 2 THEN 'Lost'
  WHEN R_Score = 2 AND (F_Score >= 3 OR M_Score >= 3) THEN 'Need Attention'
  WHEN R_Score >= 3 AND (F_Score = 1 OR M_Score = 1) THEN 'Promising'
  WHEN M_Score >= 4 THEN 'Big Spenders' ELSE 'Standard' END"""
SEGMENT_ID_SQL = """CAST(CASE RFM_Segment WHEN 'Champions' THEN 0 WHEN 'Loyal Customers' THEN 1 WHEN 'At Risk' THEN 2
  WHEN 'Lost' THEN 3 WHEN 'Need Attention' THEN 4 WHEN 'Promising' THEN 5 WHEN 'Big Spenders' THEN 6
  WHEN 'Standard' THEN 7 END AS INTEGER)"""
cte("seg0", f"SELECT *, {SEGMENT_SQL} AS RFM_Segment FROM scored")
cte("segments", f"SELECT *, {SEGMENT_ID_SQL} AS cluster FROM seg0")
_cols = ", ".join(['CustomerID', '"count"', '"min"', '"max"', '"mean"', '"sum"'] + [f"categ_{i}" for i in range(5)]
                  + ["Recency", "Frequency", "Monetary", "RFM_Segment", "cluster"])
PROFILE_COLUMNS = _cols.split(", ")
BASKET_COLUMNS = ["CustomerID", "InvoiceNo", "basket_price", "InvoiceDate", *[f"categ_{i}" for i in range(5)]]
cte("profile", f"SELECT {_cols} FROM segments")
_tsum = ", ".join(f"sum(categ_{i}) / sum(basket_price) * 100 AS categ_{i}" for i in range(5))
cte("test_prof0", f"""
SELECT CustomerID, count(*) AS n0, min(basket_price) AS "min", max(basket_price) AS "max",
  avg(basket_price) AS "mean", {_tsum}
FROM test GROUP BY CustomerID""")
cte("test_prof", """
SELECT CustomerID, n0 * 5 AS "count", "min", "max", "mean", CAST(n0 * 5 AS DOUBLE) * "mean" AS "sum",
  categ_0, categ_1, categ_2, categ_3, categ_4 FROM test_prof0""")
cte("test_labels", """
SELECT t.CustomerID, CAST(coalesce(p.cluster, 7) AS INTEGER) AS cluster
FROM test_prof t LEFT JOIN profile p ON t.CustomerID = p.CustomerID""")

# ---- report layer ----
P_MONTH, P_YEAR = "1999-03", "1999"


def cur_prev(period: str | None, src: str = "clean") -> tuple[str, str]:
    if period is None:
        last = f"(SELECT max(epoch_us(InvoiceDate)) FROM {src})"
        t = "epoch_us(InvoiceDate)"
        c = f"({last} - 30 * {DAY})"
        return f"{t} > {c}", f"({t} <= {c} AND {t} > {c} - 30 * {DAY})"
    fmt = "%Y" if len(period) == 4 else "%Y-%m"
    from tillscope.operators.reports import previous_period
    return (f"strftime(InvoiceDate, '{fmt}') = '{period}'",
            f"strftime(InvoiceDate, '{fmt}') = '{previous_period(period)}'")


def trend_sql(cur: str, prev: str) -> str:
    return (f"CASE WHEN ({prev}) = 0 THEN CAST(0 AS DOUBLE) "
            f"ELSE round(CAST(({cur}) - ({prev}) AS DOUBLE) / CAST(({prev}) AS DOUBLE) * 100, 1) END")


def kpi_sql(period: str | None) -> str:
    c, p = cur_prev(period)
    body = f"""
WITH kl AS (SELECT *, {c} AS _c, {p} AS _p FROM clean),
inv AS (SELECT InvoiceNo, bool_or(_c) AS c, bool_or(_p) AS p FROM kl GROUP BY InvoiceNo),
cus AS (SELECT CustomerID, bool_or(_c) AS c, bool_or(_p) AS p FROM kl GROUP BY CustomerID),
k AS (SELECT
  CAST(trunc(coalesce(sum(TotalPrice) FILTER (WHERE _c), 0)) AS BIGINT) AS sc,
  CAST(trunc(coalesce(sum(TotalPrice) FILTER (WHERE _p), 0)) AS BIGINT) AS sp,
  max(InvoiceDate) AS last_date,
  (SELECT count(*) FILTER (WHERE c) FROM inv) AS oc, (SELECT count(*) FILTER (WHERE p) FROM inv) AS op,
  (SELECT count(*) FILTER (WHERE c) FROM cus) AS mc, (SELECT count(*) FILTER (WHERE p) FROM cus) AS mp,
  (SELECT count(*) FROM cus) AS mall FROM kl),
k2 AS (SELECT *,
  CASE WHEN mc > 0 THEN CAST(trunc(sc / mc) AS BIGINT) ELSE 0 END AS ac,
  CASE WHEN mp > 0 THEN CAST(trunc(sp / mp) AS BIGINT) ELSE 0 END AS ap,
  CASE WHEN mall > 0 THEN round(mc / mall * 100, 1) ELSE CAST(0 AS DOUBLE) END AS ec,
  CASE WHEN mp > 0 AND mall > 0 THEN round(mp / mall * 100, 1) ELSE CAST(0 AS DOUBLE) END AS ep,
  CAST(trunc(mc * CAST(0.2 AS DOUBLE)) AS BIGINT) AS pc, CAST(trunc(mp * CAST(0.2 AS DOUBLE)) AS BIGINT) AS pp FROM k)
SELECT sc AS total_sales, {trend_sql('sc', 'sp')} AS sales_trend,
  oc AS total_orders, {trend_sql('oc', 'op')} AS orders_trend,
  mc AS total_members, {trend_sql('mc', 'mp')} AS members_trend,
  ac AS average_spend, {trend_sql('ac', 'ap')} AS average_trend,
  ec AS engagement, {trend_sql('ec', 'ep')} AS engagement_trend,
  pc AS premium_members, {trend_sql('pc', 'pp')} AS premium_trend, last_date FROM k2"""
    # the leading WITH merges with the shared CTE chain
    return sql(body.replace("WITH kl AS", "SELECT * FROM (WITH kl AS", 1) + ")", "clean")


def region_core(period: str | None) -> str:
    c, _ = cur_prev(period)
    return f"""
SELECT Country AS name, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM clean WHERE {c}) * 100, 1) AS pct,
  count(*) AS lines
FROM clean WHERE {c} GROUP BY Country ORDER BY lines DESC, name ASC LIMIT 4"""


def region_sql(period: str | None) -> str:
    return sql(region_core(period), "clean")


def region_cum_sql(period: str | None) -> str:
    c, _ = cur_prev(period)
    return sql(f"""
SELECT name, pct, round(sum(pct) OVER (ORDER BY lines DESC, name ASC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS cumulative_pct,
  CAST(round((SELECT count(DISTINCT CustomerID) FROM clean WHERE {c}) * pct / 100) AS BIGINT) AS members
FROM ({region_core(period)}) r""", "clean")


def premium_sql(period: str | None) -> str:
    c, _ = cur_prev(period)
    return sql(f"""
SELECT CustomerID, spend, spend_rank FROM (
  SELECT CustomerID, spend, row_number() OVER (ORDER BY spend DESC, CustomerID) AS spend_rank,
    count(*) OVER () AS n
  FROM (SELECT CustomerID, sum(TotalPrice) AS spend FROM clean WHERE {c} GROUP BY CustomerID) s) r
WHERE spend_rank <= CAST(trunc(n * CAST(0.2 AS DOUBLE)) AS BIGINT)""", "clean")


def daily_sql(period: str | None) -> str:
    c, _ = cur_prev(period)
    return sql(f"""
SELECT strftime(InvoiceDate, '%Y-%m-%d') AS day, CAST(trunc(sum(TotalPrice)) AS BIGINT) AS value
FROM clean WHERE {c} GROUP BY 1""", "clean")


def monthly_sql(year: str) -> str:
    c, _ = cur_prev(year)
    return sql(f"""
SELECT substr(day, 1, 7) AS month, CAST(sum(value) AS BIGINT) AS value FROM (
  SELECT strftime(InvoiceDate, '%Y-%m-%d') AS day, CAST(trunc(sum(TotalPrice)) AS BIGINT) AS value
  FROM clean WHERE {c} GROUP BY 1) d GROUP BY 1""", "clean")


cte("rep_gap", f"""
SELECT CAST((max(epoch_us(InvoiceDate)) - min(epoch_us(InvoiceDate))) // {DAY} AS DOUBLE) / (count(*) - 1) AS gap
FROM clean GROUP BY CustomerID HAVING count(*) > 1""")
cte("zs", """
SELECT CustomerID, cluster,
  (Recency - st.mr) / st.sr AS zr, (Frequency - st.mf) / st.sf AS zf, (Monetary - st.mm) / st.sm AS zm
FROM segments, (SELECT avg(Recency) AS mr, stddev_pop(Recency) AS sr, avg(Frequency) AS mf,
  stddev_pop(Frequency) AS sf, avg(Monetary) AS mm, stddev_pop(Monetary) AS sm FROM segments) st""")
cte("cst", """
SELECT cluster AS k, count(*) AS n, sum(zr * zr + zf * zf + zm * zm) AS q, sum(zr) AS s1, sum(zf) AS s2, sum(zm) AS s3
FROM zs GROUP BY cluster""")
cte("sil_pp", """
SELECT CustomerID, cluster,
  max(CASE WHEN k = cluster THEN d * n / (n - 1) END) AS a, max(CASE WHEN k = cluster THEN n END) AS own_n,
  min(CASE WHEN k <> cluster THEN d END) AS b
FROM (SELECT z.CustomerID, z.cluster, c.k, c.n,
        (zr * zr + zf * zf + zm * zm) + c.q / c.n - 2 * (zr * c.s1 + zf * c.s2 + zm * c.s3) / c.n AS d
      FROM zs z, cst c) dd
GROUP BY CustomerID, cluster""")
cte("sil", """
SELECT avg(CASE WHEN own_n <= 1 OR b IS NULL THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END) AS silhouette
FROM sil_pp""")

SEG_LABEL_SQL = """CASE cluster WHEN 0 THEN 'Champions' WHEN 1 THEN 'Loyal Customers' WHEN 2 THEN 'At Risk'
  WHEN 3 THEN 'Lost' WHEN 4 THEN 'Need Attention' WHEN 5 THEN 'Promising' WHEN 6 THEN 'Big Spenders'
  WHEN 7 THEN 'Standard' ELSE 'Cluster ' || CAST(cluster AS VARCHAR) END"""


def _story_sql() -> str:
    from tillscope.schema import SEGMENT_STORIES as s
    g = "g.basket"
    return f"""CASE WHEN freq > 50 THEN '{s[0]}'
  WHEN freq > 15 AND total_spend > 5000 THEN '{s[1]}'
  WHEN freq > 10 AND total_spend > 5000 THEN '{s[2]}'
  WHEN freq > 10 THEN '{s[3]}'
  WHEN total_spend > 5000 AND freq < 5 THEN '{s[4]}'
  WHEN total_spend > 2000 THEN '{s[5]}'
  WHEN avg_basket > {g} * 1.5 THEN '{s[6]}'
  WHEN freq < 2.5 AND avg_basket < {g} * 0.7 THEN '{s[7]}'
  ELSE '{s[8]}' END"""


def seg_sel_sql(period: str | None) -> str:
    if period is None:
        return "SELECT * FROM profile"
    c, _ = cur_prev(period)
    return f"SELECT * FROM profile WHERE CustomerID IN (SELECT CustomerID FROM clean WHERE {c})"


def seg_per_sql(period: str | None) -> str:
    _, p = cur_prev(period)
    means = ", ".join(f"avg(categ_{i})" for i in range(5))
    return f"""
SELECT s.cluster, count(*) AS customers, CAST(trunc(avg(s."mean")) AS BIGINT) AS avg_basket,
  round(avg(s."sum"), 2) AS total_spend, round(avg(s."count"), 1) AS freq,
  count(pc.CustomerID) AS prev_customers, [{means}] AS m
FROM ({seg_sel_sql(period)}) s
LEFT JOIN (SELECT DISTINCT CustomerID FROM clean WHERE {p}) pc ON s.CustomerID = pc.CustomerID
GROUP BY s.cluster"""


def segment_summary_sql(period: str | None) -> str:
    return sql(f"""
SELECT cluster AS cluster_id, {SEG_LABEL_SQL} AS name, round(CAST(customers AS DOUBLE) / g.n * 100, 1) AS share,
  customers, avg_basket, total_spend, printf('%.1f', freq) AS frequency, tr AS trend,
  CASE WHEN tr >= 0 THEN '+' || CAST(tr AS VARCHAR) || '%' ELSE CAST(tr AS VARCHAR) || '%' END AS trend_label,
  {_story_sql()} AS story,
  'Category ' || CAST(list_position(m, list_max(m)) - 1 AS VARCHAR) || ' (' || CAST(round(list_max(m), 1) AS VARCHAR) || '%)' AS focus_products
FROM (SELECT *, {trend_sql('customers', 'prev_customers')} AS tr FROM ({seg_per_sql(period)}) x) per,
  (SELECT count(*) AS n, CAST(trunc(avg("mean")) AS BIGINT) AS basket FROM ({seg_sel_sql(period)}) y) g""",
               "profile", "clean")


def segment_trend_sql(period: str | None) -> str:
    return sql(f"""
SELECT cluster, customers, prev_customers, {trend_sql('customers', 'prev_customers')} AS trend
FROM ({seg_per_sql(period)}) x""", "profile", "clean")


def segment_focus_sql(period: str | None) -> str:
    return sql(f"""
SELECT cluster, CAST(list_position(m, list_max(m)) - 1 AS INTEGER) AS focus_category, round(list_max(m), 1) AS focus_pct
FROM ({seg_per_sql(period)}) x""", "profile", "clean")


def segment_headline_sql(period: str | None) -> str:
    return sql(f"""
SELECT count(*) AS train_rows, CAST(trunc(avg("mean")) AS BIGINT) AS avg_basket, CAST(sum("count") AS BIGINT) AS monthly_txn,
  (SELECT count(*) FROM test) AS test_rows,
  (SELECT coalesce(CAST(trunc(avg(gap)) AS BIGINT), 0) FROM rep_gap) AS repeat_days,
  (SELECT round(silhouette, 3) FROM sil) AS silhouette
FROM ({seg_sel_sql(period)}) s""", "profile", "clean", "test", "rep_gap", "sil")


# product groups on the stand-in map
cte("pm2", "SELECT Description, categ_product AS ClusterID FROM pmap")


def product_stats_sql(period: str | None) -> str:
    where = ""
    if period is not None:
        c, _ = cur_prev(period)
        where = f"WHERE {c}"
    return f"""SELECT Description, avg(UnitPrice) AS UnitPrice, sum(Quantity) AS Quantity,
  sum(QuantityCanceled) AS QuantityCanceled FROM clean {where} GROUP BY Description"""


cte("smp", """
SELECT * FROM (SELECT ClusterID, Description, row_number() OVER (PARTITION BY ClusterID ORDER BY Description) AS rank
FROM pm2) s WHERE rank <= 5""")
cte("toks", """
SELECT ClusterID, rank, p, lower(t0) AS t FROM (
  SELECT ClusterID, rank, unnest(range(1, len(arr) + 1)) AS p, unnest(arr) AS t0 FROM (
    SELECT ClusterID, rank, regexp_split_to_array(Description, '[^A-Za-z0-9]+') AS arr FROM smp) a) b""")
cte("terms", """
SELECT ClusterID, max(CASE WHEN k = 1 THEN t END) AS term1, max(CASE WHEN k = 2 THEN t END) AS term2 FROM (
  SELECT ClusterID, t, row_number() OVER (PARTITION BY ClusterID ORDER BY c DESC, fr) AS k FROM (
    SELECT ClusterID, t, count(*) AS c, min(rank * 100000 + p) AS fr FROM toks
    WHERE length(t) > 2 AND NOT regexp_matches(t, '^[0-9]+$') GROUP BY ClusterID, t) x) y
WHERE k <= 2 GROUP BY ClusterID""")


def _title_sql(t: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({t}, '([a-z]+|[0-9]+)', 1), "
            f"lambda x: upper(x[1]) || x[2:]), '')")


def _normalize_sql(s: str) -> str:
    s = f"trim({s})"
    s = f"regexp_replace({s}, '\\s*&\\s*', ' ＆ ', 'g')"
    s = f"trim(regexp_replace({s}, '(?i)\\bAnd\\b\\.?$', '', 'g'))"
    s = f"regexp_replace({s}, '\\s{{2,}}', ' ', 'g')"
    s = f"regexp_replace({s}, '^[ \\-_:;,./\\\\]+|[ \\-_:;,./\\\\]+$', '', 'g')"
    s = f"replace(replace(replace({s}, 'Budget', '低価格'), 'Mid-price', '中価格'), 'Premium', 'プレミアム')"
    s = f"regexp_replace({s}, '\\s*\\(\\s*', ' (', 'g')"
    return f"regexp_replace({s}, '\\s*\\)\\s*', ')', 'g')"


def product_summary_sql(period: str | None) -> str:
    tag = "CASE WHEN avg_price <= 5 THEN '低価格' WHEN avg_price <= 20 THEN '中価格' ELSE 'プレミアム' END"
    core = f"CASE WHEN term2 IS NOT NULL THEN {_title_sql('term1')} || ' ＆ ' || {_title_sql('term2')} ELSE {_title_sql('term1')} END"
    named = f"{tag} || ' ' || {core}"
    named = f"CASE WHEN return_rate > 10 THEN {named} || '（返品多め）' ELSE {named} END"
    raw = f"CASE WHEN term1 IS NULL THEN 'Product Group ' || CAST(ClusterID AS VARCHAR) ELSE {named} END"
    return sql(f"""
SELECT ClusterID AS id, {_normalize_sql(raw)} AS name,
  round(CAST(top_skus AS DOUBLE) / (SELECT count(*) FROM pm2) * 100, 1) AS share, avg_price, keywords, top_skus, return_rate
FROM (
  SELECT per.*, CASE WHEN q + c > 0 THEN round(CAST(c AS DOUBLE) / CAST(q + c AS DOUBLE) * 100, 1) ELSE CAST(0 AS DOUBLE) END AS return_rate,
    kw.keywords, terms.term1, terms.term2
  FROM (SELECT m.ClusterID, count(*) AS top_skus, coalesce(CAST(trunc(avg(s.UnitPrice)) AS BIGINT), 0) AS avg_price,
          CAST(coalesce(sum(s.Quantity), 0) AS BIGINT) AS q, CAST(coalesce(sum(s.QuantityCanceled), 0) AS BIGINT) AS c
        FROM pm2 m LEFT JOIN ({product_stats_sql(period)}) s ON m.Description = s.Description GROUP BY m.ClusterID) per
  LEFT JOIN (SELECT ClusterID, list(Description ORDER BY rank) AS keywords FROM smp GROUP BY ClusterID) kw ON per.ClusterID = kw.ClusterID
  LEFT JOIN terms ON per.ClusterID = terms.ClusterID) z""", "pm2", "clean", "smp", "terms")

# ---- products ----
cte("prods", """
SELECT Description, avg(UnitPrice) AS mean_price FROM clean WHERE Description IS NOT NULL GROUP BY Description""")
cte("ptok", """
SELECT DISTINCT Description, t0 FROM (
  SELECT Description, unnest(string_split_regex(lower(Description), '[\\s,.;:!?()\\[\\]{}"'']+')) AS t0 FROM prods) x
WHERE length(t0) > 0""")
cte("inv", """
SELECT root, count(DISTINCT Description) AS doc_count, first(t0 ORDER BY length(t0), t0) AS keyword FROM (
  SELECT Description, t0,
    CASE WHEN suffix(t0, 'sses') THEN left(t0, length(t0) - 2)
      WHEN suffix(t0, 'ied') OR suffix(t0, 'ies') THEN
        CASE WHEN length(t0) > 4 THEN left(t0, length(t0) - 2) ELSE left(t0, length(t0) - 1) END
      WHEN regexp_matches(t0, '(x|z|ch|sh)es$') THEN left(t0, length(t0) - 2)
      WHEN suffix(t0, 'us') OR suffix(t0, 'ss') THEN t0
      WHEN suffix(t0, 's') AND regexp_matches(left(t0, length(t0) - 2), '[aeiouy]') THEN left(t0, length(t0) - 1)
      ELSE t0 END AS root
  FROM ptok WHERE regexp_matches(t0, '[a-z]')) r
GROUP BY root""")
cte("kws", """
SELECT keyword, doc_count FROM inv
WHERE keyword NOT IN ('pink', 'blue', 'tag', 'green', 'orange') AND length(keyword) >= 3
  AND doc_count >= greatest(2, CAST(trunc((SELECT count(*) FROM prods) * CAST(0.01 AS DOUBLE)) AS BIGINT))
  AND NOT contains(keyword, '+') AND NOT contains(keyword, '/')""")
cte("bands", """
SELECT Description, mean_price, band AS price_band,
  ['0<.<1', '1<.<2', '2<.<3', '3<.<5', '5<.<10', '.>10'][band + 1] AS price_label FROM (
  SELECT Description, mean_price,
    CASE WHEN coalesce(mean_price, 0) < 1 THEN 0 WHEN coalesce(mean_price, 0) < 2 THEN 1
      WHEN coalesce(mean_price, 0) < 3 THEN 2 WHEN coalesce(mean_price, 0) < 5 THEN 3
      WHEN coalesce(mean_price, 0) < 10 THEN 4 ELSE 5 END AS band FROM prods) b""")
