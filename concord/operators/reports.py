"""Findings and graphs as text: annotations, SARIF, diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions.paths import escape_data


def annotations(findings: DataFrame) -> DataFrame:
    """findings(file, line, text) -> text: a line for a continuous-integration log."""
    prop = F.replace(F.replace(escape_data(F.col("file")), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))
    return findings.select(F.concat(F.lit("::error file="), prop, F.lit(",line="), F.col("line").cast("string"), F.lit("::"), escape_data(F.col("text"))).alias("text"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result per finding, as JSON."""
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), F.struct("text").alias("message"), F.array(place).alias("locations"))).alias("text"))


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes(name) -> name, id: stable short ids in order of name; nodes are groups, one row each."""
    return nodes.withColumn("id", F.concat(F.lit("b"), (F.row_number().over(W.orderBy("name")) - 1).cast("string")))


def mermaid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges(src, dst, state) of names -> text: a diagram line each; dotted if unused, thick if undeclared."""
    n = numbered(nodes)
    j = edges.join(n.select(F.col("name").alias("src"), F.col("id").alias("a")), "src").join(n.select(F.col("name").alias("dst"), F.col("id").alias("b")), "dst")
    arrow = F.when(F.col("state") == "unused", " -.-> ").when(F.col("state") == "undeclared", " ==> ").otherwise(" --> ")
    return j.select(F.concat("a", arrow, "b").alias("text"))


def dot_edges(edges: DataFrame) -> DataFrame:
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    style = F.when(F.col("state") == "unused", " [style=dashed]").when(F.col("state") == "undeclared", " [color=red]").otherwise("")
    return edges.select(F.concat(quote("src"), F.lit(" -> "), quote("dst"), style, F.lit(";")).alias("text"))
