"""Secret scan with multipart credential linking.

Base findings (always reported): ``assign`` (a value of six or more characters given to a secret-like name), ``access``
(AKIA and 16 or more capitals and digits) and ``hex`` (24 or more hexadecimal digits).

Weak candidates are too common to report alone: ``weak_secret`` (an unbroken run of 20 or more base64 characters with
letters and digits that lies in no base finding), ``identifier`` (a value given to a user-like name) and ``endpoint`` (a URL
or a value given to a host-like name).  Each part has a scope: ``reach`` code points to both sides, and its block of the text
between blank lines or braces, however long.  An interval join (and an aggregate per block) finds the complementary parts
inside a scope: a weak secret is reported beside an access identifier, an identifier
beside a secret, an endpoint beside both.  ``access`` counts as identifier; ``assign`` and ``hex`` as secrets.

Defined cases: null text counts as empty; no findings give an empty list; parts in distinct rows never link, also if the rows
repeat each other or share doc_id; an empty table gives an empty result; other columns are not read.

Scale: one pass over the texts writes the few parts per document; the join runs on (row, place in the text), so a long
document spreads over tasks, and a bucket of ``reach`` code points holds few parts; blocks are numbered in one pass over a
document's parts and edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.common import ensure_row_ids, lookup, replaced, span_list, spans_of, written


def any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _given(*names: str) -> str:
    """``name = value`` in its usual spellings, group 1 being the value."""
    return "(?:" + "|".join(any_case(n) for n in names) + r""")["']?\x20*+[:=]\x20*["']?"""


#: Fixed values of the operator's contract.  Short matches of access and hex never contain long ones, so the
#: length limits stand in the pattern.
ASSIGN = _given("password", "passwd", "secret", "token", "api_?key") + "([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

WEAK = "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}"
IDENTIFIER = _given("user", "username", "user_?id", "login", "account", "client_?id", "key_?id") + "([A-Za-z0-9@._-]{3,})"
ENDPOINT = "[hH][tT][tT][pP][sS]?://[A-Za-z0-9.-]+(?::[0-9]+)?|" + _given("host", "hostname", "endpoint", "server") + "[A-Za-z0-9.:/-]{4,}"

#: Edges of blocks: blank lines and braces.
EDGE = r"\n[ \t\r]*\n|[{}]"

#: Kinds in report order, and the role each plays.
KINDS = {"assign": "secret", "access": "identifier", "hex": "secret", "weak_secret": "secret", "identifier": "identifier", "endpoint": "endpoint"}
BASE = ("assign", "access", "hex")


def _kind(name: str, spans: Column) -> Column:
    no = list(KINDS).index(name)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), F.lit(name).alias("kind")))


def find_parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one array of (start, no, end, kind) per kind, and ``edges``: the ends of the marks between blocks."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn("assign", _kind("assign", F.filter(spans_of(t, ASSIGN, 1), lambda s: F.char_length(s["value"]) >= 6)))
    out = out.withColumn("access", _kind("access", spans_of(t, ACCESS))).withColumn("hex", _kind("hex", spans_of(t, HEX)))
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    out = out.withColumn("weak_secret", _kind("weak_secret", F.filter(spans_of(t, WEAK), mixed)))
    out = out.withColumn("identifier", _kind("identifier", spans_of(t, IDENTIFIER))).withColumn("endpoint", _kind("endpoint", spans_of(t, ENDPOINT)))
    weak = F.size("weak_secret") + F.size("identifier") + F.size("endpoint") > 0
    edges = F.when(weak, F.transform(spans_of(t, EDGE), lambda s: s["end"])).otherwise(F.expr("cast(array() as array<int>)"))
    return out.withColumn("edges", edges)


def link_parts(parts: DataFrame, reach: int) -> DataFrame:
    """(_row, linked): the weak candidates with complementary parts in scope, from the written parts table."""
    some = parts.where(F.size("weak_secret") + F.size("identifier") + F.size("endpoint") > 0)
    role = F.lit(None).cast("string")
    for no, r in enumerate(KINDS.values()):
        role = F.when(F.col("no") == no, F.lit(r)).otherwise(role)
    edge = F.transform("edges", lambda e: F.struct(e.alias("start"), F.lit(-1).alias("no"), e.alias("end"), F.lit("edge").alias("kind")))
    flat = some.select("_row", F.explode(F.concat(*KINDS, edge)).alias("s")).select("_row", "s.*")
    # the block of a part is the number of edges up to it
    before = Window.partitionBy("_row").orderBy("start", "no").rowsBetween(Window.unboundedPreceding, 0)
    flat = flat.withColumn("block", F.count_if(F.col("no") < 0).over(before)).where("no >= 0")
    flat = written(flat.withColumn("role", role), "secret-parts")
    place = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor(b / reach)))
    weak = flat.where(F.col("no") >= len(BASE))
    around = weak.withColumn("place", place(F.col("start") - reach, F.col("end") + reach))
    near = flat.where("role != 'endpoint' or no < 3").select(
        "_row", F.col("start").alias("s"), F.col("end").alias("e"), F.col("no").alias("o"), F.col("role").alias("beside"),
        place(F.col("start"), F.col("end")).alias("place"))
    pairs = around.join(near, ["_row", "place"]).where((F.col("s") <= F.col("end") + reach) & (F.col("e") >= F.col("start") - reach))
    has = lambda column, role: F.max((F.col(column) == role).cast("int"))
    # a weak secret that lies in a base finding is that finding
    seen = pairs.groupBy("_row", "start", "no", "end").agg(
        has("beside", "identifier").alias("id"), has("beside", "secret").alias("secret"),
        F.max(((F.col("o") < len(BASE)) & (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end"))).cast("int")).alias("inside"))
    block = flat.groupBy("_row", "block").agg(has("role", "identifier").alias("id_block"), has("role", "secret").alias("secret_block"))
    known = weak.join(seen, ["_row", "start", "no", "end"], "left").join(block, ["_row", "block"])
    found = lambda what: (F.coalesce(what, F.lit(0)) == 1) | (F.col(f"{what}_block") == 1)
    linked = known.where(((F.col("role") == "secret") & found("id") & (F.coalesce("inside", F.lit(0)) == 0))
                         | ((F.col("role") == "identifier") & found("secret")) | ((F.col("role") == "endpoint") & found("id") & found("secret")))
    return linked.groupBy("_row").agg(F.collect_list(F.struct("start", "no", "end", "kind")).alias("linked"))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = 200, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, the base arrays, ``linked`` and, on request, ``redacted`` (the text with findings replaced)."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    parts = find_parts(base, "_text")
    parts = ensure_row_ids(parts if with_text else parts.drop("_text"), "secret-docs")
    out = lookup(parts, written(link_parts(parts, reach), "secret-links"), ["_row"])
    none = F.expr("cast(array() as array<struct<start:int,no:int,end:int,kind:string>>)")
    out = out.withColumn("linked", F.coalesce("linked", none))
    if with_text:
        every = F.concat(*BASE, "linked")
        out = out.withColumn("redacted", replaced(F.col("_text"), every, lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">"))))
    return out.drop("_row", "_text", "weak_secret", "identifier", "endpoint", "edges")


def op2_secret_links(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(span_list(F.concat(*BASE)), 256).alias("base_sha256"), span_list(F.concat(*BASE, "linked")).alias("spans"))


def _sql_spans(kind: str, pattern: str, group: int = 0, keep: str = "true") -> str:
    """Spans of one kind: the matches and the text between them alternate."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {[*KINDS, 'edge'].index(kind)} AS no, '{kind}' AS kind, '{KINDS.get(kind, kind)}' AS role, s AS "start", s + length(m[i]) AS "end" FROM (
  SELECT doc_id, m, v, i, (list_sum(list_transform(g[:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM (
    SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v,
        string_split_regex(text, '{p}') AS g FROM documents WHERE regexp_matches(text, '{p}')))) WHERE {keep}"""


ORACLE = "WITH base AS (" + " UNION ALL ".join([
    _sql_spans("assign", ASSIGN.replace("*+", "*"), 1, "length(v[i]) >= 6"), _sql_spans("access", ACCESS), _sql_spans("hex", HEX)]) + """),
weak AS (""" + " UNION ALL ".join([
    _sql_spans("weak_secret", "[A-Za-z0-9+/]{20,}", 0, "regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Za-z]')"),
    _sql_spans("identifier", IDENTIFIER.replace("*+", "*")), _sql_spans("endpoint", ENDPOINT.replace("*+", "*"))]) + """),
edges AS (SELECT doc_id, list("end") AS at FROM (""" + _sql_spans("edge", EDGE) + """) GROUP BY 1),
parts AS (SELECT x.*, len(list_filter(coalesce(e.at, []), lambda a: a <= x."start")) AS block
  FROM (SELECT * FROM base UNION ALL SELECT * FROM weak) x LEFT JOIN edges e USING (doc_id)),
seen AS (SELECT w.doc_id, w.no, w.kind, w.role, w."start", w."end", bool_or(p.role = 'identifier') AS id, bool_or(p.role = 'secret') AS secret,
  bool_or(p.no < 3 AND p."start" <= w."start" AND p."end" >= w."end") AS inside
  FROM parts w JOIN parts p ON p.doc_id = w.doc_id AND w.no >= 3
    AND (p.block = w.block OR (p."start" <= w."end" + 200 AND p."end" >= w."start" - 200))
  GROUP BY ALL),
linked AS (SELECT doc_id, no, kind, role, "start", "end" FROM seen WHERE (role = 'secret' AND id AND NOT inside)
  OR (role = 'identifier' AND secret) OR (role = 'endpoint' AND id AND secret)),
b AS (SELECT doc_id, count_if(no = 0) AS a, count_if(no = 1) AS c, count_if(no = 2) AS h,
  string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", no, "end") AS s FROM base GROUP BY 1),
e AS (SELECT doc_id, string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", no, "end") AS s
  FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY 1)
SELECT d.doc_id, coalesce(b.a, 0)::BIGINT AS n_assign, coalesce(b.c, 0)::BIGINT AS n_access, coalesce(b.h, 0)::BIGINT AS n_hex,
  sha256(coalesce(b.s, '')) AS base_sha256, coalesce(e.s, '') AS spans
FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN e USING (doc_id)"""
