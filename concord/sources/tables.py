"""The driver's tables as the engine's frames: nations are groups, lines of orders are imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.plans.shared import small_tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_tasks(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst (nations), file (order), line, target (supplier), name (brand of the part), of every line."""
    t = lambda n: table(spark, sf_dir, n)
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    j = l.join(t("orders").select("o_orderkey", "o_custkey"), l.l_orderkey == F.col("o_orderkey"))
    j = j.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("target"), F.col("p_brand").alias("name"))


def pairs(spark: SparkSession, sf_dir: str, rule: str, groups: int = 25) -> DataFrame:
    """Ordered pairs of a nation and a group for which rule, over src and dst, holds."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    return n.withColumn("dst", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).where("src <> dst").where(rule)


#: Groups from 0 up that can be declared: those after the nations are planned, and own no file yet.
GROUPS = 28


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, "(src * 7 + dst * 3) % 5 < 3", GROUPS)


def brands(spark: SparkSession, sf_dir: str, more: str) -> DataFrame:
    """(name): the brands, and one name that no part has."""
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    return names.unionByName(spark.createDataFrame([(more,)], "name string"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as an import: src (null where the file has not exactly one owner), file, line, specifier, kind of target, target, its owner and state, form, name."""
    e = edges(spark, sf_dir)
    kind = "CASE target % 50 WHEN 1 THEN 'dynamic' WHEN 2 THEN 'outside' WHEN 3 THEN 'relative' WHEN 4 THEN 'paths' WHEN 5 THEN 'workspace' WHEN 6 THEN 'other' ELSE 'file' END"
    state = "CASE WHEN target % 20 = 0 THEN 'ignored' WHEN target % 20 = 17 THEN 'unowned' ELSE 'owned' END"
    form = "CASE (file + line) % 11 WHEN 0 THEN 'import' WHEN 1 THEN 'export' WHEN 2 THEN 'dynamic' WHEN 3 THEN 'require' END"
    return e.selectExpr("CASE WHEN file % 9 <> 0 THEN src END AS src", "file", "line % 3 AS line", "line AS stmt", "concat('./m', target) AS specifier", f"{kind} AS kind", "target", "dst", f"{state} AS state", f"{form} AS namespace", "name")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thin graph with cycles."""
    return pairs(spark, sf_dir, "(src * 7 + dst * 5) % 23 < 2")


def acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, "src > dst and (src * 7 + dst * 5) % 11 < 2")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path: host and path of each page's address, without query and fragment."""
    return table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path")).distinct()


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, path: a source file for each part."""
    ending = "CASE p_partkey % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.d.ts' WHEN 3 THEN '.js' WHEN 4 THEN '.jsx' ELSE '/index.ts' END"
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS k", f"concat('src/g', p_partkey % 10, '/m', p_partkey, {ending}) AS path")
