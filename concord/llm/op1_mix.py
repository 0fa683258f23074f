"""Mixing sources to target weights with hash-threshold histograms.

Words are summed by source and hash bucket; nested thresholds follow from the running sums;
only the bucket that holds a source's threshold is refined, level by level; the mix is then
a filter on the hash. Nothing is sorted by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.plans.shared import cut

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash used by each level of the histogram, and the number of levels.
LEVEL_BITS, LEVELS = 10, 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digit(level: int) -> Column:
    return F.shiftrightunsigned("h", 64 - LEVEL_BITS * (level + 1)).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).cast("int")


def _prefix() -> Column:
    return F.shiftrightunsigned("h", 64 - LEVEL_BITS * LEVELS)


def shares(sizes: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """sizes(source, source_size) -> with target: the total shared by weight, none above max_repeats times its size.

    One row per source, so the global window sees sources, never documents. The level at
    which weights fill up is the first one, by ascending cap per weight, that no later
    source's cap stops.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    w = sizes.withColumn("w", F.element_at(F.array(*map(lambda x: F.lit(float(x)), cycle)), (F.pmod(rank - 1, F.lit(len(cycle))) + 1).cast("int")))
    w = w.withColumn("cap", (F.col("source_size") * max_repeats).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    up = W.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    w = (
        w.withColumn("full_before", F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_after", F.sum("w").over(up.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("w_after"))
    )
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))
    w = w.withColumn("at", F.min(fits).over(W.partitionBy())["level"])
    return w.select("source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("w"), "cap")).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, below): a document is taken `whole` times, once more if its hash prefix is less than `below`."""
    need = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    need = need.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("below", F.lit(0).cast("long"))
    rows = sized.where("size > 0")
    for level in range(LEVELS):
        if level:
            keep = need.select(F.col("source").alias("s"), F.col("below").alias("at"))
            inside = F.shiftrightunsigned("h", 64 - LEVEL_BITS * level) == F.col("at")
            rows = sized.where("size > 0").join(keep, F.col("source").eqNullSafe(F.col("s")) & inside).drop("s", "at")
        hist = rows.withColumn("digit", _digit(level)).groupBy("source", "digit").agg(F.sum("size").alias("words"))
        run = F.sum("words").over(W.partitionBy("source").orderBy("digit"))
        hist = hist.withColumn("before", run - F.col("words")).select(F.col("source").alias("s"), "digit", "words", "before")
        found = need.join(hist, F.col("source").eqNullSafe(F.col("s")) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")), "left")
        # at the last level the bucket itself goes in if that ends nearer the target
        over = F.when(F.col("rest") - F.col("before") >= F.col("words") / 2, 1).otherwise(0) if level == LEVELS - 1 else F.lit(0)
        need = cut(
            found.select(
                "source", "source_size", "target", "whole",
                (F.col("rest") - F.coalesce("before", F.lit(0))).alias("rest"),
                F.when(F.col("digit").isNull(), F.shiftleft("below", LEVEL_BITS)).otherwise(F.shiftleft("below", LEVEL_BITS) + F.col("digit") + over).cast("long").alias("below"),
            ),
            "mix-thresholds",
        )
    return need


def hashed(docs: DataFrame, id_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The sized documents (id, source, size, h) and the thresholds of each source."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hashed(docs, id_col, seed).alias("h"))
    sized = cut(sized, "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sized, thresholds(sized, shares(sizes, cycle, max_repeats))


def _repeats() -> Column:
    return (F.col("whole") + F.when(_prefix() < F.col("below"), 1).otherwise(0)).cast("int")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, repeats, taken.

    Null or empty text: size 0, taken 0. A null source is a source of its own, last in
    order. Rows with the same id share a hash and move together; a null id hashes like any
    value. Sources without words get target 0; an empty table gives no rows. Other columns
    of docs, whatever their names, are not read.
    """
    sized, need = mix_plan(docs, **options)
    need = need.withColumnRenamed("source", "s")
    joined = sized.join(need, F.col("source").eqNullSafe(F.col("s"))).withColumn("repeats", _repeats())
    return joined.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, **options) -> DataFrame:
    """The mix itself: rows of docs, all columns kept whatever their names, each as often as it is taken.

    Nulls, ties and repeated rows are as in mix_report; an empty table gives no rows.
    """
    _, need = mix_plan(docs, id_col, text_col, source_col, seed=seed, **options)
    plan = need.select(F.col("source").alias("of"), "whole", "below")
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{source_col}`").alias("source"), hashed(docs, id_col, seed).alias("h"))
    d = d.join(plan, F.col("source").eqNullSafe(F.col("of")))
    often = F.col("whole") + F.when(F.shiftrightunsigned("h", 64 - LEVEL_BITS * LEVELS) < F.col("below"), 1).otherwise(0)
    d = d.withColumn("often", often.cast("int")).where("often > 0")
    return d.select("row", F.explode(F.sequence(F.lit(1), "often"))).select("row.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
