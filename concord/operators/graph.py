"""Operators over a declared graph (src, dst): reach, paths, cycles, layers, splits.

Frontier loops cut their lineage each round; a round is a join and a distinct, so it scales
with the edges of the frontier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.operators.components import connected_components
from concord.plans.shared import cut


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, steps): shortest number of steps from src to dst, by doubling."""
    reach = cut(edges.select("src", "dst", F.lit(1).alias("steps")).distinct(), "closure")
    size = reach.count()
    while True:
        two = reach.alias("a").join(reach.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst", (F.col("a.steps") + F.col("b.steps")).alias("steps"))
        reach = cut(reach.unionByName(two).groupBy("src", "dst").agg(F.min("steps").alias("steps")), "closure")
        now, size = size, reach.agg(F.count("*"), F.sum("steps")).first()
        if now == size:
            return reach


def strong_components(reach: DataFrame) -> DataFrame:
    """(node, component) of nodes on a cycle of more than one node; component is the smallest member."""
    back = reach.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    both = reach.where("src <> dst").join(back, ["src", "dst"])
    return both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("component"))


def shortest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """starts(start) -> (start, dst, path): the shortest path to every node, ties by the smaller nodes; as many rounds as the longest has steps."""
    now = starts.select("start", F.col("start").alias("dst"), F.array("start").alias("path"))
    seen = now.where("false")
    while True:
        step = now.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst")
        step = step.select("start", F.col("next").alias("dst"), F.concat("path", F.array("next")).alias("path")).groupBy("start", "dst").agg(F.min("path").alias("path"))
        now = cut(step.join(seen.select("start", "dst"), ["start", "dst"], "left_anti"), "paths")
        if now.isEmpty():
            return seen
        seen = seen.unionByName(now)


def representative_cycles(edges: DataFrame) -> DataFrame:
    """Per strong component the shortest cycle through its smallest node."""
    comps = strong_components(closure(edges))
    inside = edges.join(comps.select(F.col("node").alias("src"), "component"), "src").join(comps.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst").where("component = other").select("src", "dst")
    paths = shortest_paths(inside, comps.select(F.col("component").alias("start")).distinct())
    return paths.where("start = dst").select(F.col("start").alias("component"), "path")


def reach_within(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, level) within depth steps of seeds(node)."""
    out = seeds.select("node", F.lit(0).alias("level"))
    front = out
    for level in range(1, depth + 1):
        step = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct().join(out.select("node"), "node", "left_anti")
        front = cut(step.withColumn("level", F.lit(level)), "reach")
        out = out.unionByName(front)
    return out


def between(reach: DataFrame, a: int, b: int) -> DataFrame:
    """Nodes on a path from a to b, ends included."""
    to = reach.where(F.col("src") == a).select(F.col("dst").alias("node"))
    back = reach.where(F.col("dst") == b).select(F.col("src").alias("node"))
    ends = reach.where((F.col("src") == a) & (F.col("dst") == b)).select(F.explode(F.array("src", "dst")).alias("node"))
    return to.join(back, "node", "left_semi").unionByName(ends).distinct()


def simple_paths(edges: DataFrame, a: int, b: int) -> DataFrame:
    """(path): all paths without repeated nodes from a to b.

    Only edges into nodes that reach b are followed. The number of paths may grow
    exponentially with the edges; all are returned.
    """
    reach = closure(edges).where(F.col("dst") == b).select("src").unionByName(edges.sparkSession.createDataFrame([(b,)], "src int")).distinct()
    useful = cut(edges.select("src", "dst").distinct().join(reach.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"), "simple")
    now = useful.where((F.col("src") == a) & (F.col("dst") != a)).select("dst", F.array("src", "dst").alias("path"))
    done = now.where(F.col("dst") == b)
    while True:
        now = now.where(F.col("dst") != b).join(useful.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst")
        now = cut(now.where(~F.array_contains("path", F.col("next"))).select(F.col("next").alias("dst"), F.concat("path", F.array("next")).alias("path")), "simple")
        if now.isEmpty():
            return done.select("path")
        done = done.unionByName(now.where(F.col("dst") == b))


def path_list(paths: DataFrame, limit: int = 50) -> DataFrame:
    """paths(path) -> path, place, more: the first `limit`, shortest first, and whether there are others."""
    first = paths.orderBy(F.size("path"), "path").limit(limit + 1)  # a report: limit + 1 rows at most from here on
    rows = first.withColumn("place", F.row_number().over(W.orderBy(F.size("path"), "path")).cast("long")).withColumn("more", F.count("*").over(W.partitionBy()) > limit)
    return rows.where(F.col("place") <= limit)


def layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, height): 0 without dependencies, else one more than the highest dependency; the nodes of a cycle share the height of their component."""
    comps = strong_components(closure(edges)).toDF("member", "component")
    named = lambda df, c: df.join(comps.withColumnRenamed("member", c), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    whole = cut(named(named(edges.select("src", "dst"), "src"), "dst").where("src <> dst").distinct(), "layers")
    rows = named(nodes.select("node"), "node").distinct().withColumn("height", F.lit(0))
    front, level = rows, 0
    while True:
        level += 1
        front = cut(whole.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct(), "layers")
        if front.isEmpty():
            break
        rows = rows.unionByName(front.withColumn("height", F.lit(level)))
    top = rows.groupBy("node").agg(F.max("height").alias("height"))
    own = nodes.select("node", "node").toDF("node", "at").join(comps, F.col("node") == F.col("member"), "left").select("node", F.coalesce("component", "at").alias("at"))
    return own.join(top.withColumnRenamed("node", "at"), "at").select("node", "height")


def split_groups(uses: DataFrame) -> DataFrame:
    """uses(file, dependent, name) -> (file, dependent, part): dependents that share a name, directly or not, are one part, called by its smallest.

    A file has parts if it has two or more; one with a dependent that names nothing (name
    null) could be used whole by it, and has none.
    """
    whole = uses.where("name is null").select("file").distinct()
    u = uses.where("name is not null").join(whole, "file", "left_anti").select("file", "dependent", "name").distinct()
    node = F.struct("file", F.lit(0).alias("kind"), F.col("dependent").cast("string").alias("id"))
    parts = connected_components(u.select(node.alias("a"), F.struct("file", F.lit(1).alias("kind"), F.col("name").alias("id")).alias("b")))
    of = u.select("file", "dependent", node.alias("node")).distinct().join(parts, "node").select("file", "dependent", "component")
    named = of.groupBy("file", "component").agg(F.min("dependent").alias("part"))
    many = named.groupBy("file").agg(F.count("*").alias("n")).where("n > 1").select("file")
    return of.join(named, ["file", "component"]).join(many, "file", "left_semi").select("file", "dependent", "part")
