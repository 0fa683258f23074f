"""Totals over folders: each file counts for every folder above it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions.paths import ancestors, dirname


def folder_rollup(files: DataFrame) -> DataFrame:
    """files(path, flag) -> folder, total, flagged, subfolders (distinct folders right below that hold files)."""
    f = files.withColumn("up", ancestors(F.col("path")))
    rows = f.select(F.posexplode("up").alias("pos", "folder"), "flag", "up")
    below = F.when(F.col("pos") + 1 < F.size("up"), F.col("up")[F.col("pos") + 1])
    return rows.withColumn("below", below).groupBy("folder").agg(F.count("*").alias("total"), F.sum(F.col("flag").cast("long")).alias("flagged"), F.countDistinct("below").alias("subfolders"))


def group_unowned(files: DataFrame, least: int = 5) -> DataFrame:
    """files(path, flag) -> at, n: flagged files, or in their place the topmost folder that holds no other file, as folder/** with its number of files.

    Only files below top folders that hold a flagged file count, and files at the root stand
    alone. A folder with folders in it is skipped if it is a top one, holds more than half of
    all those files, or is the only folder of a skipped one. Of a folder with fewer than
    `least` files the files are named.
    """
    flagged = files.where("flag")
    below = files.where(F.col("path").contains("/")).withColumn("top", F.substring_index("path", "/", 1))
    below = below.join(below.where("flag").select("top").distinct(), "top", "left_semi")
    total = F.broadcast(below.agg(F.count("*").alias("of")))  # one row
    folders = folder_rollup(below)
    up = F.posexplode(ancestors(F.col("path"))).alias("k", "folder")
    rows = below.where("flag").select("path", up).join(folders, "folder").crossJoin(total)
    by = W.partitionBy("path").orderBy("k")
    rows = rows.withColumn("only", F.coalesce(F.lag("subfolders").over(by) == 1, F.lit(False)))
    rows = rows.withColumn("chain", F.sum(F.when(F.col("only"), 0).otherwise(1)).over(by))
    base = (F.col("k") == 0) | (F.col("total") * 2 > F.col("of"))
    skipped = (F.col("subfolders") > 0) & F.bool_or(base).over(W.partitionBy("path", "chain").orderBy("k"))
    best = rows.withColumn("skipped", skipped).where("total = flagged and not skipped").groupBy("path").agg(F.min_by("folder", "k").alias("folder"), F.min_by("total", "k").alias("n"))
    joined = flagged.select("path").join(best, "path", "left")
    grouped = F.col("n") >= least
    return joined.select(F.when(grouped, F.concat("folder", F.lit("/**"))).otherwise(F.col("path")).alias("at"), F.when(grouped, F.col("n")).alias("n")).distinct()


def by_folder_and_owner(files: DataFrame) -> DataFrame:
    """files(path, owner) -> folder, owner, n: runs of files with one owner in one folder."""
    return files.groupBy(dirname(F.col("path")).alias("folder"), "owner").agg(F.count("*").alias("n"))


def share_over(counts: DataFrame, total: int, limit: float) -> DataFrame:
    """Globs whose hits are more than `limit` of all files."""
    return counts.where(F.col("hits") > F.lit(limit) * F.lit(total)).withColumn("total", F.lit(total).cast("long"))
