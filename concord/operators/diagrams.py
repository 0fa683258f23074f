"""Whole diagrams as ordered lines; nodes are the groups of one project, whose number its configuration bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import text as X

#: Fixed value: the colour of what is not declared.
RED = "#d1242f"


def edge_label(state: Column, reason: Column) -> Column:
    said = F.coalesce(reason, F.lit(""))
    return F.when(state == "undeclared", "not declared").when(state == "unused", F.concat(said, F.lit(" (no import)"))).otherwise(said)


def _public(files: Column) -> Column:
    return F.when(F.size(files) == 0, "closed, no public file").otherwise(F.concat(F.lit("public: "), F.array_join(files, ", ")))


def _lines(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(ord, name, files, public) with their ids; edges(src, dst, state, reason) between them, numbered in order of the nodes."""
    n = nodes.withColumn("id", F.concat(F.lit("p0_b"), (F.row_number().over(W.orderBy("ord")) - 1).cast("string")))
    end = lambda a, b: n.select(F.col("name").alias(a), F.col("id").alias(b), F.col("ord").alias(f"{b}_ord"))
    e = edges.join(end("src", "a"), "src").join(end("dst", "b"), "dst")
    return n, e.withColumn("k", F.row_number().over(W.orderBy("a_ord", "b_ord")) - 1)


def _text(section: int, k: Column, text: Column) -> list[Column]:
    return [F.lit(section).alias("section"), k.cast("long").alias("k"), text.alias("text")]


def mermaid(nodes: DataFrame, edges: DataFrame, title: str) -> DataFrame:
    """(section, k, text): the lines of a Mermaid flowchart, in order of section and k; unused edges dashed, undeclared ones red."""
    n, e = _lines(nodes, edges)
    spark, zero = nodes.sparkSession, F.lit(0)
    one = lambda section, text: spark.range(1).select(*_text(section, zero, text))
    label = X.mermaid_label(F.concat(F.col("name"), F.lit(" ("), X.counted(F.col("files"), "file", "files"), F.lit(")")))
    comment = F.concat(F.lit("    %% "), X.one_line(F.concat(F.col("name"), F.lit(" "), _public(F.col("public")))))
    arrow = F.when(F.col("state") == "used", " -->").otherwise(" -.->")
    line = F.concat(F.lit("  "), "a", arrow, F.lit('|"'), X.mermaid_label(edge_label(F.col("state"), F.col("reason"))), F.lit('"| '), "b")
    style = lambda section, state, how: (
        e.where(F.col("state") == state).agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("at")).where("at <> ''").select(*_text(section, zero, F.concat(F.lit("  linkStyle "), "at", F.lit(f" {how}"))))
    )
    parts = [
        one(0, F.lit("flowchart TB")),
        one(1, F.concat(F.lit('  subgraph p0["'), X.mermaid_label(F.lit(title)), F.lit('"]'))),
        n.select(*_text(2, F.col("ord") * 2, comment)),
        n.select(*_text(2, F.col("ord") * 2 + 1, F.concat(F.lit("    "), "id", F.lit('["'), label, F.lit('"]')))),
        one(3, F.lit("  end")),
        e.select(*_text(4, F.col("k"), line)),
        style(5, "unused", "stroke-dasharray:6 4"),
        style(6, "undeclared", f"stroke:{RED},stroke-dasharray:2 4"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dot(nodes: DataFrame, edges: DataFrame, title: str) -> DataFrame:
    """(section, k, text): the lines of a Graphviz digraph, in order of section and k."""
    n, e = _lines(nodes, edges)
    zero = F.lit(0)
    one = lambda section, text: nodes.sparkSession.range(1).select(*_text(section, zero, text))
    label = X.dot_string(F.concat(F.col("name"), F.lit(" ("), X.counted(F.col("files"), "file", "files"), F.lit(")")))
    red = X.dot_string(F.lit(RED))
    style = F.when(F.col("state") == "used", "").when(F.col("state") == "unused", ", style=dashed").otherwise(F.concat(F.lit(", style=dotted, color="), red, F.lit(", fontcolor="), red))
    parts = [
        one(0, F.lit("digraph groups {")), one(1, F.lit("  rankdir=TB;")), one(2, F.lit("  node [shape=box];")), one(3, F.lit("  subgraph cluster_p0 {")),
        one(4, F.concat(F.lit("    label="), X.dot_string(F.lit(title)), F.lit(";"))),
        n.select(*_text(5, F.col("ord"), F.concat(F.lit("    "), "id", F.lit(" [label="), label, F.lit(", tooltip="), X.dot_string(_public(F.col("public"))), F.lit("];")))),
        one(6, F.lit("  }")),
        e.select(*_text(7, F.col("k"), F.concat(F.lit("  "), "a", F.lit(" -> "), "b", F.lit(" [label="), X.dot_string(edge_label(F.col("state"), F.col("reason"))), style, F.lit("];")))),
        one(8, F.lit("}")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
