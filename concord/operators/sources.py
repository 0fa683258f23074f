"""Listings and seeded projects as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import paths as P
from concord.operators.resolve import is_source


def classify(paths: DataFrame, config: str, settings: str = "tsconfig.json") -> DataFrame:
    """paths(path) -> kind, path: distinct sources, and the folders of configurations and settings files; installed packages are left out."""
    p = F.col("path")
    named = lambda name: P.basename(p) == name
    kind = F.when(is_source(p), "source").when(named(config), "config").when(named(settings), "settings")
    kept = paths.where((p != "") & ~p.rlike(r"(^|/)node_modules/")).withColumn("kind", kind).where("kind is not null")
    return kept.select("kind", F.when(F.col("kind") == "source", p).otherwise(P.dirname(p)).alias("path")).distinct()


def _draw(seed: int, *salt: str) -> F.Column:
    """A number from 0 to 2^28 - 1 that depends on the seed and the salts alone, so a row is the same in any partitioning."""
    return F.conv(F.left(F.md5(F.concat_ws("/", F.lit(str(seed)), *salt)), F.lit(7)), 16, 10).cast("long")


def project_files(groups: DataFrame, per_group: int, seed: int) -> DataFrame:
    """A seeded project of groups(grp): path, grp; one public file a group."""
    f = groups.select("grp", F.explode(F.sequence(F.lit(0), F.lit(per_group - 1))).alias("k"))
    name = F.when(F.col("k") == 0, "index").otherwise(F.concat(F.lit("f"), F.col("k").cast("string")))
    ending = F.when(_draw(seed, F.lit("ending"), F.col("grp").cast("string"), F.col("k").cast("string")) % 5 == 0, ".tsx").otherwise(".ts")
    return f.select(F.concat(F.lit("src/b"), F.col("grp").cast("string"), F.lit("/"), name, ending).alias("path"), "grp")


def project_imports(groups: DataFrame, per_group: int, fan: int, reach: int, seed: int) -> DataFrame:
    """Imports of a seeded project of groups(grp): src, k (a file), line, dst (a group below reach), private (not through the group's public file)."""
    f = groups.select(F.col("grp").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(per_group - 1))).alias("k"))
    f = f.withColumn("line", F.explode(F.sequence(F.lit(1), F.lit(fan)))).withColumn("line", F.col("line").cast("long"))
    salt = [F.col(c).cast("string") for c in ("src", "k", "line")]
    return f.select("src", "k", "line", (_draw(seed, F.lit("dst"), *salt) % reach).alias("dst"), (_draw(seed, F.lit("private"), *salt) % 10 == 0).alias("private"))


def stale_edges(edges: DataFrame, removed: DataFrame, added: DataFrame, analysed: DataFrame) -> DataFrame:
    """edges(file, line, specifier, target; kind: file, outside, unresolved or dynamic) that must resolve again after removed(path) and added(path).

    Files in analysed(path) or removed bring their own edges. A target that is gone asks for its edge; any file
    that came asks for the unresolved ones, for specifiers that end in its name, and for those of a folder alone.
    """
    name = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"\.(d\.)?[cm]?[jt]sx?$", "")
    # a folder's index file answers to the folder's name too
    stems = added.select(F.explode(F.array(name(F.col("path")), F.when(name(F.col("path")) == "index", P.basename(P.dirname(F.col("path")))))).alias("stem"))
    stems = stems.where("stem <> ''").distinct().withColumn("by_name", F.lit(True))
    some = added.limit(1).select(F.lit(True).alias("any_added"))
    gone = removed.select(F.col("path").alias("target")).distinct().withColumn("by_target", F.lit(True))
    kept = edges.where("kind <> 'dynamic'").join(analysed.unionByName(removed).select(F.col("path").alias("file")).distinct(), "file", "left_anti")
    j = kept.withColumn("stem", name(F.col("specifier"))).join(stems, "stem", "left").join(gone, "target", "left").join(F.broadcast(some), F.lit(True), "left")
    folder = F.col("specifier").rlike(r"(^|/)\.{1,2}$")
    again = F.col("by_target").isNotNull() | F.col("by_name").isNotNull() | (F.col("any_added").isNotNull() & ((F.col("kind") == "unresolved") | folder))
    return j.where(again).select("file", "line", "specifier", "target")
