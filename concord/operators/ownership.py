"""Owners of files by ordered globs.

A file belongs to a group if the last of the group's globs that matches it is positive.
Ignored files are taken out first and count for no group's globs. The pattern join is an
equi-join: a file's folders meet the globs' literal folders, and the expression is tried on
what meets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions.globs import literal_segments, static_prefix, to_regex
from concord.functions.paths import ancestors


def glob_table(spark: SparkSession, globs: list[tuple[str | None, str]]) -> DataFrame:
    """(group or None for ignored, glob) in order -> glob_id, owner, glob, negative, prefix, regex, literal."""
    rows = [(i, g, x, x.startswith("!"), static_prefix(x), to_regex(x), literal_segments(x)) for i, (g, x) in enumerate(globs)]
    return spark.createDataFrame(rows, "glob_id int, owner string, glob string, negative boolean, prefix string, regex string, literal int")


def pattern_join(files: DataFrame, globs: DataFrame) -> DataFrame:
    """files(path) x globs -> a row per path and matching glob."""
    folders = files.select("path", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("prefix"))
    return folders.join(globs, "prefix").where(F.rlike("path", "regex")).drop("prefix", "regex")


def effective(matches: DataFrame) -> DataFrame:
    """Per path and owner: is the glob the last to match, and does it take effect (a negative undoes only a positive)."""
    by = W.partitionBy("path", F.coalesce("owner", F.lit("\0")))
    last = F.row_number().over(by.orderBy(F.desc("glob_id"))) == 1
    before = F.lag("negative").over(by.orderBy("glob_id"))
    return matches.withColumn("last", last).withColumn("counts", ~F.col("negative") | F.coalesce(~before, F.lit(False)))


def matches(files: DataFrame, globs: DataFrame) -> DataFrame:
    """Matches that count: ignored files leave before groups' globs are looked at."""
    every = effective(pattern_join(files, globs))
    ignored = every.where("owner is null and last and not negative").select("path").distinct()
    return every.where("owner is null").unionByName(every.where("owner is not null").join(ignored, "path", "left_anti"))


def owners(files: DataFrame, globs: DataFrame) -> DataFrame:
    """path, state (owned, ignored, unowned, overlap), owner, owners (joined by ',', fewest literal parts first)."""
    won = matches(files, globs).where("last and not negative")
    per = won.groupBy("path").agg(
        F.max(F.col("owner").isNull()).alias("ignored"),
        F.array_sort(F.collect_list(F.when(F.col("owner").isNotNull(), F.struct("literal", "owner")))).alias("found"),
    )
    joined = files.select("path").join(per, "path", "left")
    n = F.coalesce(F.size("found"), F.lit(0))
    state = F.when(F.coalesce("ignored", F.lit(False)), "ignored").when(n > 1, "overlap").when(n == 1, "owned").otherwise("unowned")
    return joined.select("path", state.alias("state"), F.when(state == "owned", F.col("found")[0]["owner"]).alias("owner"), F.coalesce(F.array_join(F.transform("found", lambda x: x["owner"]), ","), F.lit("")).alias("owners"))


def glob_hits(files: DataFrame, globs: DataFrame) -> DataFrame:
    """glob_id, hits of every glob, 0 included."""
    hits = matches(files, globs).where("counts").groupBy("glob_id").agg(F.count("*").alias("hits"))
    return globs.select("glob_id", "glob").join(hits, "glob_id", "left").select("glob_id", "glob", F.coalesce("hits", F.lit(0)).alias("hits"))


def changed_owners(before: DataFrame, added: DataFrame, removed: DataFrame, globs: DataFrame) -> DataFrame:
    """owners() of the files after a change, from those before: only added(path) are matched. A path both removed and added counts as added."""
    gone = removed.select("path").unionByName(added.select("path")).distinct()
    return before.join(gone, "path", "left_anti").unionByName(owners(added.select("path").distinct(), globs))


def changed_hits(before: DataFrame, added: DataFrame, removed: DataFrame, globs: DataFrame) -> DataFrame:
    """glob_hits() of the files after a change, from those before: hits of added(path) and removed(path), distinct and in the list or not as they say, count plus and minus one."""
    signed = lambda files, sign: glob_hits(files, globs).select("glob_id", "glob", (F.col("hits") * sign).alias("hits"))
    return before.select("glob_id", "glob", "hits").unionByName(signed(added, 1)).unionByName(signed(removed, -1)).groupBy("glob_id", "glob").agg(F.sum("hits").alias("hits"))
