"""Text rules as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
# Word separators for product descriptions: whitespace and punctuation that splits
# words; '+', '/', '-' stay inside a token.
TOKEN_SEPARATORS = r"""[\s,.;:!?()\[\]{}"']+"""
VOWELS = "[aeiouy]"


def tokens(description: Column) -> Column:
    """Lower-case word tokens of a description (empty tokens dropped)."""
    return F.filter(F.split(F.lower(description), TOKEN_SEPARATORS), lambda t: F.length(t) > 0)


def plural_root(t: Column) -> Column:
    """Root of an English word for grouping surface forms: the plural step of the
    Snowball English stemmer (sses -> ss; ied/ies -> i, or ie for short words; xes, zes, ches and
    shes lose es, so that boxes meets box; us and ss stay; a final s goes when a vowel occurs before the letter preceding it)."""
    n = F.length(t)

    def cut(k):
        return F.left(t, n - k)

    return (F.when(t.endswith("sses"), cut(2))
            .when(t.endswith("ied") | t.endswith("ies"), F.when(n > 4, cut(2)).otherwise(cut(1)))
            .when(t.rlike("(x|z|ch|sh)es$"), cut(2))
            .when(t.endswith("us") | t.endswith("ss"), t)
            .when(t.endswith("s") & cut(2).rlike(VOWELS), cut(1))
            .otherwise(t))


def table_name(stem: str) -> str:
    """File stem -> table name: lower case, every run outside [a-z0-9] is one '_', edges trimmed;
    empty -> 'artifact'."""
    return re.sub("[^a-z0-9]+", "_", stem.lower()).strip("_") or "artifact"
