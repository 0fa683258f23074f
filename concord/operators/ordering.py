"""Places in a total order, without one task that sees every row."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.plans.shared import cut


def places(df: DataFrame, by: list[Column | str], name: str = "place") -> DataFrame:
    """df with each row's place from 1 in the order of by, which no two rows may share.

    Rows are dealt out by range; a place is the row's within its range, after the counts of the
    ranges before, of which there are as many as shuffle partitions.
    """
    ranged = cut(df.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["__range"], r["count"]) for r in ranged.groupBy("__range").count().collect())
    starts = list(zip([k for k, _ in sizes], accumulate([n for _, n in sizes], initial=0), strict=False))
    before = df.sparkSession.createDataFrame(starts, "__range int, __before long")
    own = F.row_number().over(W.partitionBy("__range").orderBy(*by))
    out = ranged.withColumn("__own", own).join(F.broadcast(before), "__range")
    return out.select(*df.columns, (F.col("__before") + F.col("__own")).alias(name))
