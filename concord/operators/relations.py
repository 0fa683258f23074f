"""Declared against observed relations between groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import paths as P

PAIR = ["src", "dst"]


def pair_counts(edges: DataFrame) -> DataFrame:
    """Imports of each pair of different groups, and the first of them by (file, line)."""
    cross = edges.where("src <> dst")
    return cross.groupBy(*PAIR).agg(F.count("*").alias("imports"), F.min(F.struct("file", "line")).alias("first")).select(*PAIR, "imports", F.col("first.file").alias("first_file"), F.col("first.line").alias("first_line"))


def undeclared(edges: DataFrame, declared: DataFrame) -> DataFrame:
    return pair_counts(edges).join(declared, PAIR, "left_anti")


def unused(edges: DataFrame, declared: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Declared pairs nobody imports; sources in held(src) are left alone, as their imports are not all known."""
    out = declared.where("src <> dst").join(edges.select(*PAIR).distinct(), PAIR, "left_anti")
    return out.join(held, "src", "left_anti").select(*PAIR) if held is not None else out.select(*PAIR)


def edge_state(edges: DataFrame, declared: DataFrame) -> DataFrame:
    found = pair_counts(edges).select(*PAIR, "imports")
    both = declared.select(*PAIR, F.lit(True).alias("declared")).join(found, PAIR, "full_outer")
    state = F.when(F.col("declared").isNull(), "undeclared").when(F.col("imports").isNull(), "unused").otherwise("used")
    return both.select(*PAIR, state.alias("state"), F.coalesce("imports", F.lit(0)).alias("imports"))


def undeclared_keys(found: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found and not declared, with their number."""
    return found.groupBy(*keys).agg(F.count("*").alias("uses")).join(declared, keys, "left_anti")


def grouped_imports(statements: DataFrame, declared: DataFrame) -> DataFrame:
    """Imports of pairs that are not declared: of the statements (stmt) of one (file, line, target) the first one's names win."""
    first = statements.where("src <> dst").join(declared, PAIR, "left_anti").groupBy(*PAIR, "file", "line", "target").agg(F.min_by("name", F.struct("stmt", "name")).alias("name"))
    return first.groupBy(*PAIR).agg(F.count("*").alias("statements"), F.countDistinct("target").alias("targets"), F.min("name").alias("least_name"))


def private_imports(edges: DataFrame, declared: DataFrame, public: DataFrame) -> DataFrame:
    """Imports along declared pairs of targets that are not public; names merged per statement."""
    return edges.where("src <> dst").join(declared, PAIR, "left_semi").join(public, "target", "left_anti").groupBy(*PAIR, "target").agg(F.count("*").alias("imports"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def unused_exports(exports: DataFrame, edges: DataFrame) -> DataFrame:
    """exports(target, name) that no other group uses."""
    return exports.join(edges.where("src <> dst").select("target", "name").distinct(), ["target", "name"], "left_anti")


def first_listed(listed: DataFrame, owned: DataFrame) -> DataFrame:
    """Of the groups that list a file those that own it; the first in order."""
    rank = F.row_number().over(W.partitionBy("file").orderBy("pos"))
    return listed.join(owned, ["file", "owner"], "left_semi").withColumn("rank", rank).where("rank = 1").select("file", "owner")


def top_dependents(declared: DataFrame, n: int = 3) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("dst").orderBy("src"))
    top = declared.withColumn("rank", rank).where(F.col("rank") <= n)
    return top.groupBy("dst").agg(F.array_join(F.transform(F.array_sort(F.collect_list("src")), lambda x: x.cast("string")), ",").alias("dependents"))


def reexports(imports: DataFrame) -> DataFrame:
    """imports(public, target, name or null for none, type_only, is_type) -> public, target, types, text: the statements by which a public file would export what is imported; a name is a type only if no import takes it as a value."""
    name = F.when(F.col("name").isNull(), "name").when(F.col("name") == "default", F.concat(F.lit("default as "), P.default_export_name(F.col("target")))).otherwise(F.col("name"))
    as_type = F.col("name").isNotNull() & (F.coalesce("type_only", F.lit(False)) | F.coalesce("is_type", F.lit(False)))
    each = imports.select("public", "target", name.alias("shown"), as_type.alias("types")).groupBy("public", "target", "shown").agg(F.bool_and("types").alias("types"))
    names = each.groupBy("public", "target", "types").agg(F.array_join(F.array_sort(F.collect_list("shown")), ", ").alias("names"))
    text = F.concat(F.lit("export "), F.when(F.col("types"), "type ").otherwise(""), F.lit("{ "), "names", F.lit(" } from '"), P.reexport_specifier(F.col("public"), F.col("target")), F.lit("'"))
    return names.select("public", "target", "types", text.alias("text"))


def first_export(public: DataFrame, exports: DataFrame) -> DataFrame:
    """public(grp, ord, file), exports(file, name) -> grp, name, file: the first public file of a group that exports the name."""
    return exports.join(public, "file").groupBy("grp", "name").agg(F.min_by("file", "ord").alias("file"))
