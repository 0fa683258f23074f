"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is an aggregation with map-side combine and an equi-join that adaptive execution
can split, so a node with a third of all links does not land in one task. The number of
rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.plans.shared import cut, free, scratch


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """links(a, b) -> (node, component): component is the smallest node reachable.

    Only nodes with a link to another node are returned; null ends and self-links are
    ignored; repeated links count once; no links give no rows.
    """
    with scratch() as made:
        return made.keep(_components(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), max_rounds))


def _components(e: DataFrame, max_rounds: int) -> DataFrame:
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, e = e, cut(small.where("u <> v").distinct(), "links")
        free(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return cut(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
        before = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
