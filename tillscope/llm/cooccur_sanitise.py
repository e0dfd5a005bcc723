"""Information-theoretic sanitisation of personal data.

Base findings (always reported and replaced): ``email``, ``ip``, ``card`` and ``phone``; each distinct value is a protected
entity.  Words of its documents can give it away even when the value is gone.  How strongly word t reveals
entity e is computed from the corpus: PMI(e, t) / IC(e), with PMI(e, t) = log2(P(e, t) / (P(e) P(t))) and
IC(e) = log2(1 / P(e)), all over documents; 1 means that t occurs only where e does.  All words of e's documents are judged
and, wherever they stand in them, those whose share is at least ``remove_at`` are removed, from ``generalise_at`` on they are
generalised (``remove`` and ``generalise`` spans).  A word is a run of letters of any length; words inside a base finding
are counted, but have no span of their own.  Pairs of fewer than ``support`` documents are left out; the query has no
such floor (``support`` = 1), so entities and words of one document are judged too.

Defined cases: null text counts as empty; documents without a finding have no spans; an entity that is in every document reveals
nothing (IC is 0); ties at a threshold count as above it; repeated rows count as documents of their own; an empty
table gives an empty result; other columns are not read.

Scale: one pass over the texts writes findings and, for documents with a finding, their words; document frequencies are
counted over all texts, pre-aggregated per task.  Entities of the same documents have the same shares and are judged once
(as one class), and a word is paired only with classes for which its frequency can still reach the threshold (exact bound: it
would stand in every document it could share); pair counts are pre-aggregated, so a hot entity is a few rows per task;
flagged pairs return to their documents through ``lookup``.  Words of more than ``FREQUENT`` documents get their frequency
through ``lookup``; the others are no hot keys and join plainly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import ensure_row_ids, lookup, replaced, span_list, spans_of, written

#: Fixed values of the operator's contract, written so that no input makes the search slow or deep: repeated groups are
#: possessive (nothing follows that could need a character back) and a run of leading characters is tried once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
BASE = KINDS[:4]
#: A word: letters with their marks.
TERM = r"\p{L}[\p{L}\p{M}]*+"
#: Words whose places are added up together.
BLOCK = 128
#: Words of more documents are joined as possible hot keys.
FREQUENT = 1000


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _fits(kind: str):
    def size(s: Column, least: int, most: int) -> Column:
        n = F.length(digits_of(s["value"]))
        return (n >= least) & (n <= most)

    def octet(p: Column) -> Column:
        return F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")
    return {"email": lambda s: F.lit(True),
            "ip": lambda s: F.forall(F.split(s["value"], r"\."), octet),
            "card": lambda s: F.when(size(s, 12, 19), passes_luhn(digits_of(s["value"]))).otherwise(F.lit(False)),
            "phone": lambda s: size(s, 9, 15)}[kind]


def find_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``found``: (start, no, end, kind, entity)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs

    def entity(no: int, kind: str):
        def of(s: Column) -> Column:
            value = F.lower(s["value"]) if kind == "email" else s["value"] if kind == "ip" else digits_of(s["value"])
            return F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind"),
                            F.concat(F.lit(kind + ":"), value).alias("entity"))
        return of

    for no, (kind, regex) in enumerate(zip(BASE, (EMAIL, IP, CARD, PHONE))):
        out = out.withColumn(f"_{kind}", F.transform(F.filter(spans_of(t, regex), _fits(kind)), entity(no, kind)))
    return out.withColumn("found", F.concat(*[f"_{k}" for k in BASE])).drop(*[f"_{k}" for k in BASE])


def with_words(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``words`` to documents with a finding: (term, start, end) of all words, lower-cased, with their places.

    Places are added up in blocks, so a long text costs little more than its number of words.
    """
    found, gaps = F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)), F.split(F.col(text), TERM, -1)
    parts = F.zip_with(found, gaps, lambda w, g: F.struct(F.lower(w).alias("term"), F.char_length(w).alias("len"),
                                                          (F.char_length(g) + F.char_length(w)).alias("step")))
    docs = docs.withColumn("_parts", F.when(F.size("found") > 0, F.slice(parts, 1, F.size(found))))
    one = "array<struct<term:string,start:int,end:int>>"
    place = lambda acc, p: F.struct((acc["pos"] + p["step"]).alias("pos"), F.concat(acc["out"], F.array(F.struct(
        p["term"].alias("term"), (acc["pos"] + p["step"] - p["len"]).alias("start"), (acc["pos"] + p["step"]).alias("end")))).alias("out"))
    block = lambda i: F.aggregate(F.slice("_parts", i * BLOCK + 1, BLOCK),
                                  F.struct(F.lit(0).alias("pos"), F.expr(f"cast(array() as {one})").alias("out")), place)
    move = lambda acc, b: F.struct((acc["pos"] + b["pos"]).alias("pos"), F.concat(acc["out"], F.array(F.transform(
        b["out"], lambda s: F.struct(s["term"].alias("term"), (s["start"] + acc["pos"]).alias("start"), (s["end"] + acc["pos"]).alias("end"))))).alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_parts") - 1) / BLOCK).cast("int")), block)
    words = F.aggregate(blocks, F.struct(F.lit(0).alias("pos"), F.expr(f"cast(array() as array<{one}>)").alias("out")), move, lambda acc: F.flatten(acc["out"]))
    return docs.withColumn("words", F.when(F.size("_parts") > 0, words)).drop("_parts")


def _share(both: Column, n_e: Column, n_t: Column, n_docs: int) -> Column:
    """PMI(e, t) / IC(e)."""
    log2 = lambda x: F.log2(x.cast("double"))
    pmi = log2(both * F.lit(float(n_docs)) / (n_e * n_t.cast("double")))
    return F.round(pmi / log2(F.lit(n_docs) / n_e), 9)


def disclosing_words(found: DataFrame, texts: DataFrame, text: str, n_docs: int, support: int, generalise_at: float) -> DataFrame:
    """(_row, term, share) of the words that reveal an entity of their document at or above ``generalise_at``."""
    entities = found.select("_row", F.explode(F.array_distinct("found.entity")).alias("entity"))
    # entities with the same documents have the same number and the same sums of document hashes
    rows = [F.bit_xor(F.xxhash64("_row", F.lit(i))).alias(f"class_{i}") for i in range(2)]
    by_entity = written(entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), *rows)
                        .where((F.col("n_e") < n_docs) & (F.col("n_e") >= support)), "private-entities")
    one = F.struct("class_0", "class_1", "n_e")
    classes = written(lookup(entities, by_entity, ["entity"], "inner").groupBy("_row").agg(F.collect_set(one).alias("classes")), "private-classes")
    most = by_entity.agg(F.max("n_e")).first()[0] or 0
    terms = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))
    # no pair has more documents than its word or its entity: a share below the threshold by that bound stays below it
    reaches = lambda n_e: _share(F.least(n_e, F.col("n_t")), n_e, F.col("n_t"), n_docs) >= generalise_at
    by_term = written(texts.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "private-words")
    # only words of more than FREQUENT documents can be hot keys, and they are few
    often = written(by_term.where(F.col("n_t") > FREQUENT), "private-frequent")
    rare = by_term.where(F.col("n_t") <= FREQUENT)
    wanted = (F.col("n_t") >= support) & (reaches(F.lit(most)) if most else F.lit(False))
    near = lookup(found.select("_row", F.explode(F.array_distinct("words.term")).alias("term")), often, ["term"])
    near = near.where("n_t is not null").where(wanted).select("_row", "term", "n_t").unionByName(
        near.where("n_t is null").drop("n_t").join(rare.where(wanted), "term").select("_row", "term", "n_t"))
    near = near.join(classes, "_row").withColumn("c", F.explode(F.filter("classes", lambda c: reaches(c["n_e"])))).select("_row", "term", "n_t", "c.*")
    near = written(near, "private-near")
    key = ["class_0", "class_1", "n_e", "term", "n_t"]
    # an entity of one document shares that one with its words: its bound is its share
    alone = near.where("n_e = 1").withColumn("share", _share(F.lit(1), F.col("n_e"), F.col("n_t"), n_docs))
    near = near.where("n_e > 1")
    pairs = near.groupBy(*key).agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support) \
        .withColumn("share", _share(F.col("both"), F.col("n_e"), F.col("n_t"), n_docs)).where(F.col("share") >= generalise_at)
    pairs = written(pairs.select(*key, "share"), "private-pairs")
    hot = F.col("n_e") > FREQUENT
    near = near.where(~hot).join(pairs.where(~hot), key).unionByName(lookup(near.where(hot), written(pairs.where(hot), "private-hot"), key, "inner"))
    return near.unionByName(alone.select(*near.columns)).groupBy("_row", "term").agg(F.max("share").alias("share"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = 3,
             generalise_at: float = 0.8, remove_at: float = 0.95, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, ``base`` and ``terms`` spans and, on request, ``sanitised`` (the text without what they mark).

    A base finding becomes its kind, a removed word goes, a generalised word becomes its first letter and length class.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    all_ = with_words(find_entities(own, "_text"), "_text")
    found = ensure_row_ids(all_ if with_text else all_.drop("_text"), "private-docs")
    n_docs = found.count()
    words = written(disclosing_words(found, own, "_text", n_docs, support, generalise_at), "private-flagged")
    marked = found.select("_row", F.explode("words").alias("w")).select("_row", "w.*").join(words, ["_row", "term"])
    no = F.when(F.col("share") >= remove_at, F.lit(KINDS.index("remove"))).otherwise(F.lit(KINDS.index("generalise")))
    marked = marked.select("_row", F.struct("start", no.alias("no"), "end", F.element_at(F.array(*[F.lit(k) for k in KINDS]), no + 1).alias("kind")).alias("s"))
    marked = written(marked.groupBy("_row").agg(F.collect_list("s").alias("terms")), "private-marked")
    out = lookup(found, marked, ["_row"])
    none = F.expr("cast(array() as array<struct<start:int,no:int,end:int,kind:string>>)")
    base = F.transform("found", lambda f: F.struct(f["start"].alias("start"), f["no"].alias("no"), f["end"].alias("end"), f["kind"].alias("kind")))
    out = out.withColumn("base", base).withColumn("terms", F.coalesce("terms", none)) \
        .withColumn("terms", F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))
    if with_text:
        word = lambda s: F.substring(F.col("_text"), s["start"] + 1, F.lit(1))
        long = lambda s: F.when(s["end"] - s["start"] > 7, F.lit("++")).otherwise(F.lit("+"))
        label = lambda s: F.when(s["kind"] == "remove", F.lit("")).when(s["kind"] == "generalise", F.concat(word(s), long(s))) \
            .otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        out = out.withColumn("sanitised", replaced(F.col("_text"), F.concat("base", "terms"), label))
    return out.drop("_row", "_text", "found", "words")


def op5_cooccur_sanitise(spark, sf_dir: str) -> DataFrame:
    got = sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), support=1)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *[count(k) for k in BASE], F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
                      span_list(F.concat("base", "terms")).alias("spans"))
