"""URL filter: explicit rules first, else empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host.  Each host's bad rate gets a beta prior from its registered
domain, the domain's from its suffix, the suffix's from all pages.  The strength of the prior at a level is the
beta-binomial precision of that level, estimated from the spread of the level's rates by moments.  A host is
blocked if even the lower posterior bound (mean - z sd) of its bad rate is above ``max_bad``.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.  Path: from there up to ``?``, ``#`` or the
end.  Registered domain: the last two labels; suffix: the last label (with ``suffixes``, public suffixes of several
labels count as one).  A rule ``host/path`` fits its host and all subdomains when the path starts with the rule's; the
longest fitting rule wins.

Defined cases: a null url, or one without ``://``, has empty host and path, which form a host of their own; unlabelled hosts
take the prior of their domain, and without any label at all every host is allowed; null outcomes are no labels;
repeated pages count as often as they occur; an empty table gives an empty result; extra columns pass through,
and columns named like result columns are replaced.

Scale: one aggregate by host with partial sums; the host table joins back through ``lookup`` (broadcast only
below a checked size, else salted, so one host may hold any share of the pages).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import lookup, lower_ascii, written

#: Fixed values of the operator's contract: (rule, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
Z, MAX_BAD = 1.645, 0.5


def with_host(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return df.withColumn("host", lower_ascii(host)).withColumn("path", path)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, kind in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


#: Labels that stand before a country's in public suffixes of two labels.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
ADDRESS = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?$"
TWO_LABELS = r"(^|\.)(" + "|".join(SECOND_LABELS) + r")\.[a-z]{2}$"


def _labels(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def domain_of(host: Column, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(registered domain, public suffix): ``a.co.uk`` under ``co.uk``, a numeric address as a domain of its own under
    ``address``, else the last two labels under the last; ``suffixes`` names further suffixes of two labels."""
    two = host.rlike(TWO_LABELS)
    for s in suffixes:
        two = two | host.endswith("." + s) | (host == s)
    address = host.rlike(ADDRESS)
    return (F.when(address, host).when(two, _labels(host, 3)).otherwise(_labels(host, 2)),
            F.when(address, F.lit("address")).when(two, _labels(host, 2)).otherwise(_labels(host, 1)))


def _precision(groups: DataFrame, largest: float = 1e4, least: float = 1.0) -> float:
    """Beta-binomial precision of the groups' rates (n, k) by moments."""
    t = groups.where("n > 0").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("g"),
                                  F.sum(F.col("n").cast("double") ** 2).alias("nn"),
                                  F.sum(F.col("k").cast("double") ** 2 / F.col("n")).alias("kkn")).first()
    if not t.n or t.g < 2:
        return largest
    m = t.k / t.n
    spread = t.kkn - t.n * m * m  # sum of n (rate - m)^2
    base, room = m * (1 - m), t.n - t.nn / t.n - (t.g - 1)
    if base <= 0 or room <= 0:
        return largest
    rho = (spread - base * (t.g - 1)) / (base * room)
    return min(largest, max(least, 1 / rho - 1)) if rho > 0 else largest


def host_reputation(pages: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """One row per host from (host, bad), bad being 1, 0 or null: n, k, posterior mean and sd of the bad rate."""
    host = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k"))
    domain, suffix = domain_of(F.col("host"), suffixes)
    host = host.withColumn("domain", domain).withColumn("suffix", suffix)
    host = written(host, "reputation-hosts")
    domain = written(host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "reputation-domains")
    suffix = written(domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "reputation-suffixes")
    s_host, s_domain, s_suffix = (_precision(x) for x in (host, domain, suffix))
    total = suffix.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = (total.k + 0.0) / total.n if total.n else 0.0
    post = lambda prior, s: (prior * s + F.col("k")) / (F.col("n") + s)
    suffix = written(suffix.select("suffix", post(F.lit(mean), s_suffix).alias("prior")), "reputation-s")
    domain = written(lookup(domain, suffix, ["suffix"]).select("domain", post(F.col("prior"), s_domain).alias("prior")), "reputation-d")
    out = lookup(host, domain, ["domain"]).withColumn("mean", post(F.col("prior"), s_host))
    size = F.col("n") + s_host
    return out.select("host", "n", "k", "prior", "mean", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1)).alias("sd"))


def filter_urls(pages: DataFrame, outcomes: DataFrame | None = None, url: str = "url", rules=RULES, z: float = Z,
                max_bad: float = MAX_BAD) -> DataFrame:
    """``pages`` with host, path, rule and verdict.  ``outcomes``: pages with host and bad (1, 0, null); default none."""
    at = with_host(pages, url)
    seen = at.select("host", F.lit(None).cast("int").alias("bad"))
    hosts = host_reputation(seen if outcomes is None else seen.unionByName(outcomes.select("host", F.col("bad").cast("int"))))
    judged = written(hosts.select("host", (F.col("mean") - z * F.col("sd") > max_bad).alias("_bad_host")), "reputation-verdicts")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = lookup(at, judged, ["host"])
    method = F.when(F.col("_bad_host"), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, method)).drop("_bad_host")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages whose path names a labelled document (``/xx/<doc_id>``): bad if toxic or of low quality."""
    at = with_host(pages).select("host", F.try_to_number(F.regexp_extract("path", r"^/[a-z]+/([0-9]{1,18})", 1), F.lit("9" * 18)).cast("long").alias("doc_id"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")).alias("bad"))
    return lookup(at.where("doc_id is not null"), written(known, "reputation-labels"), ["doc_id"], "inner").select("host", "bad")


def op3_host_reputation(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    outcomes = page_outcomes(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


ORACLE = rf"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hp),
known AS (SELECT doc_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
seen AS (SELECT p.host, k.bad FROM p LEFT JOIN known k ON k.doc_id = try_cast(regexp_extract(p.path, '^/[a-z]+/([0-9]{{1,18}})', 1) AS BIGINT)),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k,
  CASE WHEN regexp_matches(host, '{ADDRESS}') THEN host WHEN regexp_matches(host, '{TWO_LABELS}') THEN array_to_string(string_split(host, '.')[-3:], '.')
    ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
  CASE WHEN regexp_matches(host, '{ADDRESS}') THEN 'address' WHEN regexp_matches(host, '{TWO_LABELS}') THEN array_to_string(string_split(host, '.')[-2:], '.')
    ELSE string_split(host, '.')[-1] END AS suffix FROM seen GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY 1),
levels AS (SELECT 'h' AS level, n, k FROM h UNION ALL SELECT 'd', n, k FROM d UNION ALL SELECT 's', n, k FROM s),
moments AS (SELECT level, sum(n) AS n, sum(k) AS k, count(*) AS g, sum(n::DOUBLE * n) AS nn, sum(k::DOUBLE * k / n) AS kkn
  FROM levels WHERE n > 0 GROUP BY level),
terms AS (SELECT level, n, g, k / n AS m, kkn - n * (k / n) * (k / n) AS spread, n - nn / n - (g - 1) AS room FROM moments),
strength AS (SELECT level, CASE WHEN g < 2 OR m * (1 - m) <= 0 OR room <= 0 OR spread <= m * (1 - m) * (g - 1) THEN 1e4
  ELSE least(1e4, greatest(1.0, m * (1 - m) * room / (spread - m * (1 - m) * (g - 1)) - 1)) END AS s FROM terms),
t AS (SELECT sum(k) / sum(n) AS mean FROM s),
ps AS (SELECT suffix, ((SELECT mean FROM t) * x.s + k) / (n + x.s) AS prior FROM s, (SELECT s FROM strength WHERE level = 's') x),
pd AS (SELECT d.domain, (prior * x.s + k) / (n + x.s) AS prior FROM d JOIN ps USING (suffix), (SELECT s FROM strength WHERE level = 'd') x),
ph AS (SELECT h.host, (prior * x.s + k) / (n + x.s) AS mean, n + x.s AS size FROM h JOIN pd USING (domain), (SELECT s FROM strength WHERE level = 'h') x),
v AS (SELECT host, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM ph),
r AS (SELECT p.*, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, r.host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block'
  WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' ELSE v.verdict END AS verdict
FROM r LEFT JOIN v USING (host)"""
