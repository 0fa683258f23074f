"""The plan that turns private imports into re-exports of a public file: which names it takes on, and which imports must stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import paths as P
from concord.plans.shared import cut, free, scratch


def private_groups(private: DataFrame, undeclared: DataFrame) -> DataFrame:
    """private and undeclared (project, src, dst, file, line, target, names, private) -> the private imports of both, with place (by file, line and target) in their group (project, dst), and whether their pair is declared."""
    both = private.withColumn("declared", F.lit(True)).drop("private").unionByName(undeclared.where("private").withColumn("declared", F.lit(False)).drop("private"))
    place = F.row_number().over(W.partitionBy("project", "dst").orderBy("file", "line", "target", "src"))
    return both.withColumn("place", place)


def exported_as(name, target):
    """What a re-export calls a name of a target: the default export goes by its file's name."""
    return F.when(name == "default", P.default_export_name(target)).otherwise(name)


def reexported(imports: DataFrame, reexports: DataFrame, exports: DataFrame) -> DataFrame:
    """imports(grp, target, name) whose name a public file of the group has already: reexports(grp, file, target, name) by name, exports(grp, file, name) shown."""
    have = reexports.select("grp", "file", "target", "name").distinct().withColumn("shown", exported_as(F.col("name"), F.col("target")))
    have = have.join(exports.select("grp", "file", F.col("name").alias("shown")).distinct(), ["grp", "file", "shown"], "left_semi")
    return imports.select("grp", "target", "name").distinct().join(have, ["grp", "target", "name"], "left_semi")


def plan(imports: DataFrame, exported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names to add, what becomes of each import).

    imports(grp, place, target, names: array of (name, as_type)), places distinct in a group; exported(grp, shown,
    target, name, type_only). An import is routed whole or stays. It stays for `no-names`; for `exported`, if the
    public file shows one of its names from elsewhere, or as a type where a value is asked; or for `planned`, if
    an import before it that is routed takes the name for something else. Names to add: grp, shown, target, name,
    type_only (no routed import takes it as a value).

    An import's fate hangs on those before it that share a name, so all are settled in rounds: an import is
    routed once all its names are its own, or shared in the same sense, among the first that are still in
    question or routed; it stays once one is taken. The first of those in question is settled in every round.
    """
    keys = ["grp", "place"]
    with scratch() as made:
        every = cut(imports.select(*keys, "target", "names"), "fix-imports")
        names = every.select(*keys, "target", F.posexplode("names").alias("nth", "n")).select(*keys, "target", "nth", "n.name", "n.as_type")
        names = names.withColumn("shown", exported_as(F.col("name"), F.col("target")))
        # of one import's names that are shown alike the last is the one planned
        names = names.withColumn("wins", F.col("nth") == F.max("nth").over(W.partitionBy(*keys, "shown"))).drop("nth")
        there = exported.groupBy("grp", "shown").agg(F.min(F.struct(F.col("target").alias("t"), F.col("name").alias("n"), F.col("type_only").alias("typed"))).alias("x"))
        names = names.join(there, ["grp", "shown"], "left")
        clash = F.col("x").isNotNull() & ((F.col("x.t") != F.col("target")) | (F.col("x.n") != F.col("name")) | (F.col("x.typed") & ~F.col("as_type")))
        names = cut(names.withColumn("clash", clash), "fix-names")
        out = names.where("clash").select(*keys).distinct()
        # only names that the public file lacks can be taken by another import
        asked = names.where("x is null").select(*keys, "shown", "target", "name", "as_type", "wins").join(out, keys, "left_anti")
        fate = cut(asked.select(*keys).distinct().withColumn("fate", F.lit(None).cast("boolean")), "fix-fates")  # true: routed, false: stays
        asked = cut(asked, "fix-asked")
        by = W.partitionBy("grp", "shown")
        while not fate.where("fate is null").isEmpty():
            alive = asked.join(fate, keys).where("fate is null or fate")
            own = F.struct("target", "name")
            first = alive.withColumn("own", own).withColumn("first", F.min(F.when(F.col("wins"), F.struct("place", "own", "fate"))).over(by)).where("fate is null")
            same, itself, there = F.col("own") == F.col("first.own"), F.col("first.place") == F.col("place"), F.coalesce(F.col("first.fate"), F.lit(False))
            taken, sure = ~itself & ~same & there, itself | (same & there)
            first = first.withColumn("taken", taken).withColumn("sure", sure)
            now = first.groupBy(*keys).agg(F.max("taken").alias("taken"), F.min("sure").alias("sure"))
            settled = now.select(*keys, F.when(F.col("taken"), False).when(F.col("sure"), True).alias("new"))
            last, fate = fate, cut(fate.join(settled, keys, "left").select(*keys, F.coalesce("fate", "new").alias("fate")), "fix-fates")
            free(last)
        routed = fate.where("fate")
        added = asked.join(routed, keys, "left_semi").groupBy("grp", "shown").agg(F.min_by(F.struct("target", "name"), F.when(F.col("wins"), F.col("place"))).alias("own"), F.min("as_type").alias("type_only"))
        added = made.keep(cut(added.select("grp", "shown", "own.target", "own.name", "type_only"), "fix-added"))
        why = every.join(out.withColumn("clashes", F.lit(True)), keys, "left").join(fate, keys, "left")
        why = why.select(*keys, F.when(F.size("names") < 1, "no-names").when(F.col("clashes"), "exported").when(F.col("fate") == F.lit(False), "planned").otherwise("routed").alias("fate"))
        return added, made.keep(cut(why, "fix-fate"))
