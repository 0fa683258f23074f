"""Summaries of samples and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import text as X
from concord.functions.paths import match_score


def bench_summary(samples: DataFrame) -> DataFrame:
    """samples(scenario, ms) -> runs, median (mean of the two middle ones), p95 (nearest rank), min, max, to 0.1."""
    r = lambda c: F.round(c, 1)
    return samples.groupBy("scenario").agg(
        F.count("*").alias("runs"), r(F.median("ms")).alias("median"), r(F.expr("percentile_disc(0.95) within group (order by ms)")).alias("p95"),
        r(F.min("ms")).alias("least"), r(F.max("ms")).alias("most"),
    )


def judge(now: DataFrame, baseline: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """(scenario, median, p95) against (scenario, budget, was) -> scenario, reasons: why it fails, in an array, empty if it does not. A null budget or baseline judges nothing."""
    j = now.join(baseline, "scenario", "left")
    ms = lambda c: X.rounded(F.col(c))
    over = F.when(F.col("p95") > F.col("budget"), F.concat(F.lit("p95 "), ms("p95"), F.lit(" ms is over the budget of "), ms("budget"), F.lit(" ms")))
    share = F.floor((F.col("median") / F.col("was") - 1) * 100 + 0.5).cast("string")
    slow = F.when((F.col("was") > 0) & (F.col("median") > F.col("was") * (1 + tolerance)), F.concat(F.lit("median "), ms("median"), F.lit(" ms is "), share, F.lit("% over the baseline of "), ms("was"), F.lit(" ms")))
    return j.select("scenario", F.array_compact(F.array(over, slow)).alias("reasons"))


def twice_failed(before: DataFrame, now: DataFrame) -> DataFrame:
    """Of two runs' judge(): the scenarios that failed in both, with the later reasons; one failure alone counts as noise."""
    return now.where("size(reasons) > 0").join(before.where("size(reasons) > 0").select("scenario"), "scenario", "left_semi")


def exit_code(findings: DataFrame) -> DataFrame:
    """findings(kind) -> one row: 3 with an environment problem, else 1 with a violation, else 0."""
    code = F.when(F.coalesce(F.bool_or(F.col("kind") == "environment"), F.lit(False)), 3).when(F.coalesce(F.bool_or(F.col("kind") == "violation"), F.lit(False)), 1).otherwise(0)
    return findings.agg(code.alias("code"))


def per_group(findings: DataFrame) -> DataFrame:
    """findings(rule, groups array) -> a count per rule and group; a finding counts for each of its groups once."""
    g = F.explode_outer(F.array_distinct("groups"))
    return findings.select("rule", g.alias("grp")).groupBy("rule", F.coalesce("grp", F.lit("no group")).alias("grp")).agg(F.count("*").alias("n"))


def reason_advice(texts: DataFrame, names: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """texts(at, text) -> at, why: generic (only filler words and names of groups) or short (fewer than `least` words in all)."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(X.WORD), F.lit(0))
    rest = F.filter(words, lambda w: ~w.isin(*X.FILLER) & ~F.regexp_replace(w, "[.:]+$", "").isin(*names))
    why = F.when(F.size(rest) == 0, "generic").when(F.size(words) < least, "short")
    return texts.withColumn("why", why).where("why is not null").select("at", "why")


def search(items: DataFrame, query: str, limit: int) -> DataFrame:
    """items(kind, label) -> kind, label, score of the best: equal, then prefixes, then starts of a part of the name, then anywhere; groups before exports before files, short before long."""
    found = items.withColumn("score", match_score(F.col("kind"), F.col("label"), query)).where("score is not null")
    rank = F.when(F.col("kind") == "bucket", 0).when(F.col("kind") == "export", 1).otherwise(2)
    return found.orderBy("score", rank, F.length("label"), "label").limit(limit).select("kind", "label", "score")
