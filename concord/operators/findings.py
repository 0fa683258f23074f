"""Findings of a check: imports dispatched by what they reach, rules over them, their union in a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.operators.ordering import places

#: The rules in the order of a report.
RULES = (
    "config-invalid", "config-cycle", "dependency-undeclared", "dependency-unused", "import-private", "import-unresolved", "import-ignored", "import-dynamic", "import-namespace",
    "file-unowned", "file-overlap", "glob-empty", "public-missing", "public-not-interface", "project-undeclared", "export-unused", "package-undeclared", "package-unused",
)
UNRESOLVED = ("relative", "paths", "workspace")


def owned_sources(imports: DataFrame) -> DataFrame:
    """Imports of files with exactly one owner; others make no edges."""
    return imports.where("src is not null")


def dispatch(imports: DataFrame) -> DataFrame:
    """imports(src, dst, kind, state) of owned files -> with class: dynamic, package, unresolved, ignored or cross; what stays in its group, or leads nowhere, is left out."""
    kind = F.col("kind")
    own = owned_sources(imports).where(~((kind == "file") & (F.col("state") == "owned") & (F.col("src") == F.col("dst"))))
    found = (
        F.when(kind == "dynamic", "dynamic").when(kind == "outside", "package").when(kind.isin(*UNRESOLVED), "unresolved")
        .when((kind == "file") & (F.col("state") == "ignored"), "ignored").when((kind == "file") & (F.col("state") == "owned"), "cross")
    )
    return own.withColumn("class", found).where("class is not null")


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows with one key the first by line and statement."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy("line", "stmt"))
    return rows.withColumn("__first", first).where("__first = 1").drop("__first")


def dynamic(edges: DataFrame) -> DataFrame:
    return once(edges.where("class = 'dynamic'"), ["file", "line"]).select("file", "line")


def unresolved(edges: DataFrame) -> DataFrame:
    return once(edges.where("class = 'unresolved'"), ["file", "specifier"]).select("file", "line", "src", "specifier", "kind")


def ignored(edges: DataFrame) -> DataFrame:
    return once(edges.where("class = 'ignored'"), ["file", "target"]).select("file", "line", "target")


def namespace(edges: DataFrame) -> DataFrame:
    """Imports of everything across groups; they still count for the pair and for privacy."""
    return once(edges.where("class = 'cross' and namespace is not null"), ["file", "line", "specifier"]).select("file", "line", "src", "dst", F.col("namespace").alias("form"), "specifier")


def private(edges: DataFrame, declared: DataFrame, public: DataFrame) -> DataFrame:
    """Imports along declared(src, dst) of what public(target) leaves out, the first of each file and target."""
    inner = edges.where("class = 'cross'").join(declared, ["src", "dst"], "left_semi").join(public, "target", "left_anti")
    return once(inner, ["file", "target"]).select("file", "line", "src", "dst", "target")


def consumers(edges: DataFrame, public: DataFrame) -> DataFrame:
    """(target, name, src, imports) of public files' names; imports of everything name nothing."""
    named = edges.where("class = 'cross' and namespace is null").join(public, "target", "left_semi")
    return named.groupBy("target", "name", "src").agg(F.count("*").alias("imports"))


def guards(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """groups(src) -> src, unresolved_from (its declared relations may be used unseen), hold_all (any group's may)."""
    bad = edges.where("class = 'unresolved'")
    flags = bad.groupBy("src").agg(F.lit(True).alias("unresolved_from"))
    hold = F.broadcast(edges.agg(F.coalesce(F.bool_or((F.col("class") == "unresolved") & (F.col("kind") != "relative")), F.lit(False)).alias("hold_all")))  # one row
    return groups.join(flags, "src", "left").crossJoin(hold).select("src", F.coalesce("unresolved_from", F.lit(False)).alias("unresolved_from"), "hold_all")


def public_missing(listed: DataFrame, files: DataFrame) -> DataFrame:
    """listed(owner, file) against files(file, state, group): not-found, ignored, unowned or other-group."""
    j = listed.join(files, "file", "left")
    why = F.when(F.col("state").isNull(), "not-found").when(F.col("state") == "ignored", "ignored").when(F.col("state") == "unowned", "unowned").when(F.col("group") != F.col("owner"), "other-group")
    return j.withColumn("why", why).where("why is not null").select("owner", "file", "why")


def public_not_interface(public: DataFrame, code: DataFrame, reexports: DataFrame, owners: DataFrame, external: DataFrame, declared: DataFrame) -> DataFrame:
    """What a public file holds beside named re-exports of its own group: grp, file, line, kind, specifier, source, source_grp.

    public(grp, file); code(file, line); reexports(file, line, specifier, star, target); owners(file, grp),
    one a file; external(grp): entries of a library, which may pass on by name what declared(src, dst)
    offers. kind is code (the first line of it), export-star (once for each statement) or foreign-reexport
    (once for each source, its first line; a source in two statements counts if either may not pass it on).
    """
    own = public.select("grp", "file").distinct()
    first = code.groupBy("file").agg(F.min("line").alias("line"))
    none = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    lines = own.join(first, "file").select("grp", "file", "line", F.lit("code").alias("kind"), none("specifier"), none("source"), none("source_grp", own.schema["grp"].dataType))
    passed = own.join(reexports, "file")
    stars = passed.where("star").select("grp", "file", "line", F.lit("export-star").alias("kind"), "specifier", none("source"), none("source_grp", own.schema["grp"].dataType)).distinct()
    foreign = passed.join(owners.select(F.col("file").alias("target"), F.col("grp").alias("source_grp")), "target").where("source_grp <> grp")
    may = external.select("grp").join(declared.select(F.col("src").alias("grp"), F.col("dst").alias("source_grp")), "grp").distinct().withColumn("may", F.lit(True))
    foreign = foreign.join(may, ["grp", "source_grp"], "left").where("star or may is null")
    foreign = foreign.groupBy("grp", "file", "target", "source_grp").agg(F.min("line").alias("line"))
    foreign = foreign.select("grp", "file", "line", F.lit("foreign-reexport").alias("kind"), none("specifier"), F.col("target").alias("source"), "source_grp")
    return lines.unionByName(stars).unionByName(foreign)


def finding(rows: DataFrame, rule: str, file: Column, line: Column, *identity: str | Column) -> DataFrame:
    """rule, file, line, key: the key is a JSON list of the rule and what identifies the finding."""
    return rows.select(F.lit(rule).alias("rule"), file.cast("string").alias("file"), line.cast("int").alias("line"), F.to_json(F.array(F.lit(rule), *(F.col(c).cast("string") if isinstance(c, str) else c for c in identity))).alias("key"))


def ordered(parts: list[DataFrame]) -> DataFrame:
    """All findings with their place: by file, line (none first), rule and key."""
    every = reduce(DataFrame.unionByName, parts).distinct()
    return places(every, [F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), F.col("rule"), F.col("key")])


def per_rule(findings: DataFrame) -> DataFrame:
    """A count for each rule that found something, with the rule's place in RULES."""
    place = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule")).cast("int")
    return findings.groupBy("rule").agg(F.count("*").alias("n")).withColumn("place", place)


def worse(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rules whose findings an edit adds to: new keys, or more of them."""
    new = after.join(before, ["rule", "key"], "left_anti").groupBy("rule").agg(F.count("*").alias("new_keys"))
    count = lambda df, c: df.groupBy("rule").agg(F.count("*").alias(c))
    j = count(after, "now").join(count(before, "was"), "rule", "left").join(new, "rule", "left").fillna(0, ["was", "new_keys"])
    return j.where("new_keys > 0 or now > was").select("rule", "was", "now", "new_keys")


def renames(unknown: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """unknown(group, dependency) that the version before (name, pos) had -> from, to, referenced_by: to is the first name that is new; none without one."""
    added = F.broadcast(after.join(before, "name", "left_anti").agg(F.min_by("name", "pos").alias("to")).where("to is not null"))  # one row at most
    gone = unknown.join(before.select(F.col("name").alias("dependency")), "dependency", "left_semi").join(after.select(F.col("name").alias("dependency")), "dependency", "left_anti")
    return gone.crossJoin(added).groupBy(F.col("dependency").alias("from"), "to").agg(F.array_join(F.array_sort(F.collect_set("group")), ",").alias("referenced_by"))


def sets_compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """a(id, key) and b(id, key) -> id, equal, subset (every key of a is one of b)."""
    j = a.distinct().withColumn("a", F.lit(1)).join(b.distinct().withColumn("b", F.lit(1)), ["id", "key"], "full_outer")
    return j.groupBy("id").agg(F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("equal"), F.bool_and(F.col("b").isNotNull()).alias("subset"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node): within depth steps of the seeds, down or up."""
    from concord.operators.graph import reach_within

    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach_within(edges, seeds, depth).select("node").unionByName(reach_within(up, seeds, depth).select("node")).distinct()


def matrix(edges: DataFrame, order: DataFrame) -> DataFrame:
    """edges(src, dst, state) on the axes of order(node, pos): row, col, state."""
    row, col = order.select(F.col("node").alias("src"), F.col("pos").alias("row")), order.select(F.col("node").alias("dst"), F.col("pos").alias("col"))
    return edges.join(row, "src").join(col, "dst").select("row", "col", "state")
