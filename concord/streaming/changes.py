"""Change feeds: a snapshot kept current by micro-batches, and the last good version of each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.operators.diff import overlay
from concord.plans.shared import cut


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key: a batch's changes coalesce."""
    return changes.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("rank = 1").drop("rank")


class Snapshot:
    """A keyed table kept current by foreachBatch; on_change is called only where a batch changes it."""

    def __init__(self, base: DataFrame, key: str, order: str, on_change: Callable[[DataFrame, int], None] | None = None) -> None:
        self.now, self.key, self.order, self.on_change = cut(base, "snapshot"), key, order, on_change
        self.mark = self._mark()

    def _mark(self):
        return self.now.agg(F.count("*"), F.sum(F.xxhash64(*self.now.columns).cast("decimal(38,0)"))).first()

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        self.now = cut(overlay(self.now, latest(batch, self.key, self.order), self.key), "snapshot")
        mark = self._mark()
        if mark != self.mark and self.on_change:
            self.on_change(self.now, batch_id)
        self.mark = mark


def last_good(versions: DataFrame, key: str, order: str) -> DataFrame:
    """versions(key, an order, valid, and more) -> for each key its last valid version, with held: a later one is invalid. Keys without a valid version are left out; nulls of valid are invalid."""
    valid = F.coalesce("valid", F.lit(False))
    others = [c for c in versions.columns if c not in (key, "valid")]
    per = versions.groupBy(key).agg(F.max_by(F.when(valid, F.struct(*others)), F.when(valid, F.col(order))).alias("good"), F.max(order).alias("latest"))
    return per.where("good is not null").select(key, "good.*", (F.col("latest") > F.col(f"good.{order}")).alias("held"))
