"""Stage 3: product keywords, price bands, feature vectors and product groups."""

from __future__ import annotations

import warnings

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import CountVectorizerModel, OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.rules import price_band
from tillscope.functions.text import plural_root, tokens
from tillscope.operators import kmeans as KM
from tillscope.schema import PRICE_BAND_LABELS, STOP_KEYWORDS


def products(clean: DataFrame) -> DataFrame:
    """Distinct non-null descriptions with their mean unit price."""
    return (clean.where(F.col("Description").isNotNull()).groupBy("Description")
            .agg(F.avg("UnitPrice").alias("mean_price")))


def keyword_inventory(prods: DataFrame, nouns: DataFrame | None = None) -> DataFrame:
    """Per word root: number of descriptions containing it and its shortest surface
    form (ties: alphabetical).  Tokens must contain a letter; with a lexicon ``nouns``
    (column ``word``, any case) they must stand in it or have a root that does."""
    toks = (prods.select("Description", F.explode(F.array_distinct(tokens(F.col("Description")))).alias("t0"))
            .where(F.col("t0").rlike("[a-z]"))
            .withColumn("root", plural_root(F.col("t0"))))
    if nouns is not None:
        # a few million words at most; left to the size-checked broadcast
        known = nouns.select(F.lower(F.trim("word")).alias("w")).where("w <> ''")
        known = known.unionByName(known.select(plural_root(F.col("w")).alias("w"))).distinct()
        toks = toks.withColumn("w", F.explode(F.array_distinct(F.array("t0", "root")))).join(known, "w", "left_semi").drop("w").distinct()
    return (toks.groupBy("root")
            .agg(F.count_distinct("Description").alias("doc_count"),
                 F.min(F.struct(F.length("t0").alias("n"), F.col("t0").alias("w")))["w"].alias("keyword")))


def product_keywords(prods: DataFrame, nouns: DataFrame | None = None) -> DataFrame:
    """Kept keywords: not a stop word, at least 3 letters, no '+' or '/', in at least
    max(2, 1% of products) descriptions.  The 1% floor bounds the list to at most
    100 x (mean tokens per description) entries.  ``nouns``: see ``keyword_inventory``."""
    n = prods.agg(F.count(F.lit(1))).scalar()
    floor = F.greatest(F.lit(2), (n * 0.01).cast("bigint"))
    inv = keyword_inventory(prods, nouns)
    return (inv.where(~F.col("keyword").isin(STOP_KEYWORDS) & (F.length("keyword") >= 3)
                      & (F.col("doc_count") >= floor) & ~F.col("keyword").contains("+")
                      & ~F.col("keyword").contains("/"))
            .select("keyword", "doc_count").orderBy(F.desc("doc_count"), "keyword"))   # a bounded list


def price_bands(prods: DataFrame) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in PRICE_BAND_LABELS])
    band = price_band(F.col("mean_price"))
    return prods.select("Description", "mean_price", band.alias("price_band"),
                        F.element_at(labels, band + 1).alias("price_label"))


def keyword_matrix(prods: DataFrame, keywords: DataFrame) -> DataFrame:
    """Long form of the keyword one-hot matrix: (Description, keyword) where the
    keyword is one of the description's tokens.  The keyword list is bounded (see
    ``product_keywords``), so it is broadcast."""
    toks = prods.select("Description", F.explode(F.array_distinct(tokens(F.col("Description")))).alias("keyword"))
    return toks.join(F.broadcast(keywords.select("keyword")), "keyword").select("Description", "keyword")


def product_features(prods: DataFrame, keywords: DataFrame) -> DataFrame:
    """Feature vector per product: binary keyword indicators + price-band one-hot."""
    vocab = [r["keyword"] for r in keywords.orderBy(F.desc("doc_count"), "keyword").collect()]
    cv = CountVectorizerModel.from_vocabulary(vocab, inputCol="tokens", outputCol="kw", binary=True)
    banded = price_bands(prods).withColumn("tokens", F.array_distinct(tokens(F.col("Description"))))
    onehot = OneHotEncoder(inputCols=["price_band"], outputCols=["band"], dropLast=False).fit(banded)
    x = onehot.transform(cv.transform(banded))
    return VectorAssembler(inputCols=["kw", "band"], outputCol="features").transform(x) \
        .select("Description", "features")


def cluster_products(features: DataFrame, k: int = 5, floor: float = 0.145, attempts: int = 5, starts: int = 30):
    """KMeans(k) with up to ``attempts`` seeds, each the best of ``starts`` initialisations by cost, stopping at the first
    silhouette at or above ``floor``; the best centres are kept.  Returns (map, centres, silhouette, seed).

    Silhouette is Spark's (squared Euclidean, computed from cluster statistics), so ``floor`` is a floor for this
    measure; a warning says when no seed reaches it.  The starts of a seed move in the same passes (``kmeans``).
    """
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    feats = features.persist()
    table = KM.vector_table(feats, "Description")
    best = None
    for seed in range(attempts):
        centres, cost, _ = KM.move_together(table, KM.first_centres(table, k, starts, seed))
        centres = centres[int(cost.argmin())]
        sil = ev.evaluate(feats.select("features", KM.assigned(centres).cast("double").alias("prediction")))
        if best is None or sil > best[1]:
            best = (centres, sil, seed)
        if sil >= floor:
            break
    centres, sil, seed = best
    if sil < floor:
        warnings.warn(f"product groups: silhouette {sil:.3f} is below {floor}", stacklevel=2)
    mapping = feats.select("Description", KM.assigned(centres).alias("categ_product"))
    return mapping, centres, sil, seed
