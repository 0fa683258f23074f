"""What every specifier means: relative paths, path patterns, a base folder, workspaces, links, packages and the runtime.

Each distinct pair of folder and specifier is asked once. All paths that it may be written for
go into one table of attempts, ranked by tier and place; one equi-join with the listing answers
them all, and the outcome follows from the best hit of each tier and from what the specifier's
package is. Nulls: a null specifier is `other`.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import paths as P
from concord.operators.resolve import completions, nearest_folder
from concord.plans.shared import cut, free, scratch

#: Fixed value: levels of folders that the '**' of a workspace glob stand for, at most.
WORKSPACE_DEPTH = 4
RELATIVE, PATTERN, BASE, WORKSPACE = range(1, 5)


def is_builtin(s: Column) -> Column:
    """Whether a specifier is a module of the runtime."""
    return s.startswith("node:") | s.isin(*P.BUILTINS, *P.BUILTIN_PARTS)


def _workspace_regex(glob: str) -> str | None:
    """Matches the folders that a glob names; None where it names none by its form."""
    parts = [x for x in glob.replace("\\", "/").split("/") if x not in ("", ".")]
    if not parts or ".." in parts or any(set(x) & set("*?{[") for x in parts if x not in ("*", "**")):
        return None
    level = r"(?!node_modules(/|$)|\.)[^/]+"
    deep = [i for i, x in enumerate(parts) if x == "**"]
    ways = []
    for depths in product(range(WORKSPACE_DEPTH + 1), repeat=len(deep)):
        if sum(depths) <= WORKSPACE_DEPTH:
            many = dict(zip(deep, depths, strict=True))
            steps = [y for i, x in enumerate(parts) for y in ([level] * many[i] if i in many else [level] if x == "*" else [f"\\Q{x}\\E"])]
            ways.append("/".join(steps))
    return f"^({'|'.join(ways)})$"


def workspaces(packages: DataFrame, globs: list[str]) -> DataFrame:
    """packages(folder, name) -> (name, folder) of those that the globs name, in order; '!' takes folders out again.

    '*' is one level of folders and '**' up to four, neither through node_modules or dot
    folders; other wildcards name nothing. Of folders with the same name the last in order counts.
    """
    named = F.lit(False)
    for glob in globs:  # a project's few; the last that fits decides
        out = glob.startswith("!")
        regex = _workspace_regex(glob.removeprefix("!"))
        if regex is not None:
            named = F.when(F.col("folder").rlike(regex), not out).otherwise(named)
    found = packages.where(named & (F.col("name") != "")).groupBy("name").agg(F.max("folder").alias("folder"))
    return found.select("name", "folder")


def patterns_of(asked: DataFrame, patterns: DataFrame) -> DataFrame:
    """asked(settings, specifier), patterns(settings, pattern, position, targets) -> the one pattern that counts: settings, specifier, pattern, targets, star.

    An exact pattern comes first, then the longest prefix, then the lower position. Met by
    an equi-join on the specifier's prefixes, whose number is its length.
    """
    p = patterns.select("settings", "pattern", "position", "targets", F.substring_index("pattern", "*", 1).alias("prefix"), F.instr("pattern", "*").alias("at"))
    p = p.withColumn("suffix", F.when(F.col("at") > 0, F.expr("substring(pattern, at + 1)")))
    s = asked.select("settings", "specifier").distinct()
    heads = s.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length("specifier")), lambda i: F.substring(F.col("specifier"), F.lit(1), i))))
    fits = F.when(F.col("suffix").isNull(), F.col("specifier") == F.col("pattern")).otherwise(F.endswith("specifier", F.col("suffix")) & (F.length("specifier") >= F.length("prefix") + F.length("suffix")))
    rank = F.struct(F.col("suffix").isNotNull(), -F.length("prefix"), "position")
    best = heads.join(p, ["settings", "prefix"]).where(fits).groupBy("settings", "specifier").agg(F.min_by(F.struct("pattern", "targets", "prefix", "suffix"), rank).alias("p"))
    star = F.expr("CASE WHEN p.suffix IS NULL THEN '' ELSE substring(specifier, length(p.prefix) + 1, length(specifier) - length(p.prefix) - length(p.suffix)) END")
    return best.select("settings", "specifier", "p.pattern", "p.targets", star.alias("star"))


def _replace_star(target: Column, star: Column) -> Column:
    at = F.instr(target, "*")
    return F.when(at > 0, F.concat(F.substring(target, F.lit(1), at - 1), star, F.substring(target, at + 1, F.length(target)))).otherwise(target)


def resolve(imports: DataFrame, listing: DataFrame, settings: DataFrame, patterns: DataFrame, workspaces: DataFrame, installed: DataFrame, linked: DataFrame, answers: DataFrame) -> DataFrame:
    """Every import with kind, target and pattern.

    imports(file, specifier); listing(path, listed): all files, and whether they are sources
    of the project; settings(folder, base): folders with settings, and the folder that bare
    specifiers start from, or null; patterns(settings, pattern, position, targets): by
    settings folder; workspaces(name, folder); installed(folder, name): packages of the
    node_modules in a folder; linked(name): those that lead into the project;
    answers(folder, specifier, target): what the compiler said for workspaces and '#'.

    kind: file (target the path), builtin (the specifier), package (its name); of those
    that mean no file, relative, paths (with the pattern, null for the base folder),
    workspace, or other: it is there but not listed, or nothing that a project may name.
    """
    keys = ["folder", "specifier"]
    with scratch() as made:
        # found once: the imports are many, and four look-ups start from their distinct pairs
        pairs = cut(imports.select(P.dirname(F.col("file")).alias("folder"), "specifier").where("specifier is not null").distinct(), "specifiers-pairs")
        asked = pairs
        # settings are looked for from a file in the folder
        near = nearest_folder(asked.select(F.concat(F.when(F.col("folder") == "", "").otherwise(F.concat("folder", F.lit("/"))), F.lit("*")).alias("path"), "folder").distinct().withColumnRenamed("folder", "of"), settings)
        near = near.select(F.col("of").alias("folder"), F.col("folder").alias("settings"))
        bases = settings.groupBy(F.col("folder").alias("settings")).agg(F.max("base").alias("base"))
        s = F.col("specifier")
        form = F.when((s == "") | s.startswith("/") | s.rlike(r"^[A-Za-z]:[\\/]"), "other").when(s.rlike(r"^\.\.?(/|$)"), "relative").when(s.startswith("node:"), "builtin").otherwise("bare")
        asked = asked.join(near, "folder", "left").join(bases, "settings", "left").withColumn("form", form)
        asked = asked.join(patterns_of(asked.where("form = 'bare' and settings is not null"), patterns), ["settings", "specifier"], "left")
        asked = asked.withColumn("package", F.when(F.col("form") == "bare", P.package_name(s))).withColumn("builtin", is_builtin(s))
        asked = asked.join(workspaces.select(F.col("name").alias("package"), F.lit(True).alias("in_workspace")).distinct(), "package", "left")
        asked = asked.join(linked.select(F.col("name").alias("package"), F.lit(True).alias("is_linked")).distinct(), "package", "left")
        asked = cut(asked.join(answers.groupBy(*keys).agg(F.min("target").alias("answer")), keys, "left"), "specifiers-asked")
        free(pairs)

        plain = F.regexp_replace(s, r"\?.*$", "")
        based = F.when(F.col("base") == "", s).otherwise(F.concat_ws("/", "base", "specifier"))
        bare = asked.where("form = 'bare'")
        row = lambda df, tier, place, written: df.select(*keys, F.lit(tier).alias("tier"), place.alias("nth"), written.alias("written"))
        relative = row(asked.where("form = 'relative'"), RELATIVE, F.lit(0), F.when(F.col("folder") == "", plain).otherwise(F.concat_ws("/", "folder", plain)))
        targets = bare.where("targets is not null").select(*keys, "star", F.posexplode("targets").alias("nth", "to"))
        pattern = row(targets, PATTERN, F.col("nth"), _replace_star(F.col("to"), F.col("star")))
        base = row(bare.where("base is not null"), BASE, F.lit(0), based)
        answered = row(asked.where("form = 'bare' and answer is not null"), WORKSPACE, F.lit(0), F.col("answer"))
        tried = completions(relative.unionByName(pattern).unionByName(base), "written", exact=True).drop("written")
        # a miss may be written with a bundler's query, which counts only for what is there unlisted
        queried = pattern.unionByName(base).where(F.col("written").contains("?")).withColumn("written", F.regexp_replace("written", r"\?.*$", ""))
        tried = tried.withColumn("stripped", F.lit(False)).unionByName(completions(queried, "written", exact=True).drop("written").withColumn("stripped", F.lit(True)))
        tried = tried.unionByName(answered.select(*keys, "tier", "nth", F.col("written").alias("path"), F.lit(0).alias("place"), F.lit(False).alias("stripped")))
        known = listing.groupBy("path").agg(F.max("listed").alias("listed"))
        hits = tried.join(known, "path")
        hit = F.col("listed") & (F.col("place") >= 0) & ~F.col("stripped")
        best = [F.min(F.when(hit & (F.col("tier") == t), F.struct("nth", "place", "path"))).alias(f"hit{t}") for t in (RELATIVE, PATTERN, BASE, WORKSPACE)]
        there = [F.max((F.col("tier") == t) & (F.col("nth") == 0)).alias(f"there{t}") for t in (RELATIVE, PATTERN, BASE)]
        hits = cut(hits.groupBy(*keys).agg(*best, *there), "specifiers-hits")

        # a package is installed if the node_modules of the folder or of one above it holds it
        above = bare.select(*keys, "package", F.explode(F.concat(F.array(F.lit("")), P.ancestors(F.concat("folder", F.lit("/*"))))).alias("at")).distinct()
        held = above.join(installed.select(F.col("folder").alias("at"), F.col("name").alias("package")).distinct(), ["at", "package"]).select(*keys).distinct().withColumn("is_installed", F.lit(True))
        folders = listing.select(F.explode(P.ancestors(F.col("path"))).alias("first")).distinct().withColumn("is_folder", F.lit(True))
        first = F.when(F.col("base") == "", F.col("package")).otherwise(F.concat_ws("/", "base", "package"))
        all_ = asked.join(hits, keys, "left").join(held, keys, "left").withColumn("first", first).join(folders, "first", "left")
        yes = lambda c: F.coalesce(F.col(c), F.lit(False))
        no_package = ~F.col("builtin") & ~yes("is_installed") & ~yes("in_workspace")
        file = lambda t: F.col(f"hit{t}").isNotNull()
        miss = lambda t, kind: F.when(yes(f"there{t}"), "other").otherwise(kind)
        missed = F.col("pattern").isNotNull() & (F.col("pattern") != "*") & no_package
        gone = F.col("base").isNotNull() & s.contains("/") & ~s.startswith("@") & no_package & yes("is_folder")
        kind = (
            F.when(F.col("form").isin("other", "builtin"), F.col("form"))
            .when(F.col("form") == "relative", F.when(file(RELATIVE), "file").otherwise(miss(RELATIVE, "relative")))
            .when(file(PATTERN), "file").when(missed, miss(PATTERN, "paths"))
            .when(file(BASE), "file").when(gone, miss(BASE, "paths"))
            .when(s.startswith("#"), F.when(file(WORKSPACE), "file").otherwise("other"))
            .when(F.col("builtin"), "builtin")
            .when(yes("in_workspace") | yes("is_linked"), F.when(file(WORKSPACE), "file").otherwise("workspace"))
            .otherwise("package")
        )
        chosen = F.when(F.col("form") == "relative", F.col("hit1.path")).otherwise(F.coalesce("hit2.path", "hit3.path", "hit4.path"))
        out = all_.withColumn("kind", kind).select(
            *keys, "kind",
            F.when(F.col("kind") == "file", chosen).when(F.col("kind") == "builtin", s).when(F.col("kind") == "package", F.col("package")).alias("target"),
            F.when((F.col("kind") == "paths") & missed, F.col("pattern")).alias("pattern"),
        )
        out = made.keep(cut(out, "specifiers-resolved"))
        free(asked, hits)
    found = imports.withColumn("folder", P.dirname(F.col("file"))).join(out, keys, "left")
    return found.select(*imports.columns, F.coalesce("kind", F.lit("other")).alias("kind"), "target", "pattern")
