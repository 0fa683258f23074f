"""Projects within projects: which one a path is in, which declarations name no project, which projects nobody declares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.paths import ancestors
from concord.operators.resolve import nearest_folder


def assign(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """paths(path) with project: the deepest of projects(project), by folder and '' for the root, that holds it; null if none does."""
    found = nearest_folder(paths.select("path").distinct(), projects.select(F.col("project").alias("folder")))
    return paths.join(found.withColumnRenamed("folder", "project"), "path", "left")


def _below(df: DataFrame, folder: str, above: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose folder is one of above(keys, folder) or lies in one; by an equi-join on the folder's ancestors."""
    up = df.withColumn("up", F.explode(F.concat(ancestors(F.col(folder)), F.array(F.col(folder)))))
    return up.join(above.select(*keys, F.col("folder").alias("up")).distinct(), [*keys, "up"], "left_semi").drop("up").distinct()


def missing_projects(declared: DataFrame, found: DataFrame) -> DataFrame:
    """declared(project, written, folder) without a declaration in found(project, folder); folder relative to the project."""
    return declared.join(found.select("project", "folder").distinct(), ["project", "folder"], "left_anti").select("project", "written")


def undeclared_projects(found: DataFrame, declared: DataFrame, ignored: Column) -> DataFrame:
    """found(project, folder): declarations inside a project, of which those are left that no folder of declared(project, folder) holds and that are not ignored.

    ignored: a test on path, the declaration's own in the project.
    """
    inside = found.where("folder <> ''").select("project", "folder").distinct()
    held = _below(inside, "folder", declared, ["project"])
    return inside.join(held, ["project", "folder"], "left_anti").withColumn("path", F.concat("folder", F.lit("/declared.json"))).where(~ignored).select("project", "folder")


def united(checks: list[DataFrame], covered: DataFrame) -> DataFrame:
    """Findings(project, ...) of several checks as one list: a project's come from the first check(position) in covered(position, project) that checked it, whole."""
    every = reduce(DataFrame.unionByName, [c.withColumn("position", F.lit(i)) for i, c in enumerate(checks)])
    first = covered.groupBy("project").agg(F.min("position").alias("position"))
    return every.join(first, ["project", "position"], "left_semi").drop("position")
