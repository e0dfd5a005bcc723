"""Shared, lazily built stage tables for one (session, data folder).

Registered queries reuse the stage outputs instead of rebuilding them.  The stage
hand-offs (distinct lines, clean lines, baskets, segmented customers) are written or
checkpointed into the shared ``spark.checkpoint.dir``: that cuts lineage (later plans start from a scan,
not from the whole chain with its scalar subqueries) and a lost executor costs a
re-read, not a recompute of the chain.  Smaller helpers are persisted.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tillscope.operators import baskets as B
from tillscope.operators import cancellation as C
from tillscope.operators import customers as U
from tillscope.operators.monthly import MonthlyState
from tillscope.params import Params, driver_params
from tillscope.session import ensure_checkpoint_dir, work_path
from tillscope.sources import driver_tables as T
from tillscope.sources.results import distinct_by_month, write_by_month, written

_CACHE: dict[tuple, "Context"] = {}


class Context:
    def __init__(self, spark: SparkSession, sf_dir: str, params: Params):
        self.spark, self.sf_dir, self.p = spark, sf_dir, params
        self._t: dict[str, DataFrame] = {}
        self._monthly: MonthlyState | None = None

    def _get(self, name: str, build, persist: bool = True, checkpoint: bool = False) -> DataFrame:
        if name not in self._t:
            df = build()
            if checkpoint:
                ensure_checkpoint_dir(self.spark)
                df = df.checkpoint(eager=True)
            elif persist:
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._t[name] = df
        return self._t[name]

    def raw(self) -> DataFrame:
        return self._get("raw", lambda: T.transactions(self.spark, self.sf_dir), persist=False)

    def dedup(self) -> DataFrame:
        """The de-duplicated lines, written by month: later stages read the columns they need."""
        return self._get("dedup", lambda: distinct_by_month(T.transactions(self.spark, self.sf_dir, dealt=True),
                                                            work_path(self.spark, "dedup")), persist=False)

    def matches(self) -> DataFrame:
        return self._get("matches", lambda: C.match_cancellations(self.dedup(), self.p.match_group_rows))

    def clean(self) -> DataFrame:
        """The cleaned lines, partitioned by month (with the partition column ``invoice_month``)."""
        return self._get("clean", lambda: write_by_month(C.clean_lines(self.dedup(), self.matches()),
                                                         work_path(self.spark, "clean"), laid_out=True), persist=False)

    def monthly(self) -> MonthlyState:
        """Monthly partial aggregates of the cleaned lines."""
        if self._monthly is None:
            self._monthly = MonthlyState(self.spark, work_path(self.spark, "monthly"))
            self._monthly.load(self.clean(), 0)
        return self._monthly

    def stand_in_map(self) -> DataFrame:
        return self._get("stand_in_map", lambda: B.stand_in_product_map(self.clean()))

    def baskets(self) -> DataFrame:
        return self._get("baskets", lambda: written(B.basket_rollup(self.clean(), self.stand_in_map()),
                                                    work_path(self.spark, "baskets")), persist=False)

    def train(self) -> DataFrame:
        return B.split_baskets(self.baskets(), self.p.cut_date)[0]

    def test(self) -> DataFrame:
        return B.split_baskets(self.baskets(), self.p.cut_date)[1]

    def segments(self) -> DataFrame:
        return self._get("segments", lambda: U.customer_segments(self.train()), checkpoint=True)

    def profile(self) -> DataFrame:
        return U.customer_profile(self.segments())

    def test_profile(self) -> DataFrame:
        return self._get("test_profile", lambda: U.test_profile(self.test(), self.p.test_count_scale))

    def cached(self, name: str, build, persist: bool = True, checkpoint: bool = False) -> DataFrame:
        return self._get(name, build, persist, checkpoint)


def context(spark: SparkSession, sf_dir: str, params: Params | None = None) -> Context:
    p = params or driver_params()
    key = (id(spark), sf_dir.rstrip("/"), p)
    if key not in _CACHE:
        _CACHE[key] = Context(spark, sf_dir.rstrip("/"), p)
    return _CACHE[key]
