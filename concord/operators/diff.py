"""Differences, splits and merges of keyed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, value) before and after -> key, change (added, removed, changed), old, new; nulls compare as values."""
    b = before.select("key", F.struct("value").alias("b"))
    a = after.select("key", F.struct("value").alias("a"))
    both = b.join(a, "key", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("b.value").eqNullSafe(F.col("a.value")), "changed")
    return both.withColumn("change", change).where("change is not null").select("key", "change", F.col("b.value").alias("old"), F.col("a.value").alias("new"))


def split_keys(previous: DataFrame, current: DataFrame) -> DataFrame:
    """key sets -> key, status: fresh (new), old (still there), resolved (gone)."""
    p, c = previous.select("key").distinct(), current.select("key").distinct()
    return (
        c.join(p, "key", "left_anti").withColumn("status", F.lit("fresh"))
        .unionByName(c.join(p, "key", "left_semi").withColumn("status", F.lit("old")))
        .unionByName(p.join(c, "key", "left_anti").withColumn("status", F.lit("resolved")))
    )


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(key, value) of three sides -> key, value, conflict: a side that left a key alone yields to the other."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("key", F.col("value").alias(name), F.lit(True).alias(f"in_{name}"))

    j = side(base, "b").join(side(ours, "o"), "key", "full_outer").join(side(theirs, "t"), "key", "full_outer")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y)) & F.col(f"in_{x}").eqNullSafe(F.col(f"in_{y}"))
    ours_wins = same("b", "t") | same("o", "t")
    j = j.withColumn("conflict", ~(ours_wins | same("b", "o")))
    j = j.withColumn("value", F.when(ours_wins | F.col("conflict"), F.col("o")).otherwise(F.col("t")))
    kept = F.when(ours_wins | F.col("conflict"), F.col("in_o")).otherwise(F.col("in_t"))
    return j.where(F.coalesce(kept, F.lit(False)) | F.col("conflict")).select("key", "value", "conflict")


def overlay(base: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """base as if edits(key, deleted, columns of base) were made: deletes and upserts."""
    kept = base.join(edits.select(key), key, "left_anti")
    return kept.unionByName(edits.where("not deleted").select(*base.columns))


def still_there(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Of previous findings those found again; never a new one."""
    return previous.join(current.select(*keys).distinct(), keys, "left_semi")


def list_merge(base: F.Column, ours: F.Column, theirs: F.Column) -> F.Column:
    """Three-way merge of sets: what either side added, without what either side removed."""
    gone = F.array_union(F.array_except(base, ours), F.array_except(base, theirs))
    return F.array_sort(F.array_except(F.array_union(F.array_union(base, ours), theirs), gone))
