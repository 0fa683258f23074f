"""Files and specifiers: classes of paths, parts of a listing, and the file that a specifier means.

Look-ups are equi-joins on generated candidates, not scans of the file list for each import:
each distinct specifier is expanded once into its candidates, in order, and the first that
is a listed file wins. Null paths and specifiers give null results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import paths as P

#: Extensions of sources; endings tried after a bare path, in order; endings that stand in for a written one, in order.
SOURCE_EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")
TRIED = (".ts", ".tsx", ".d.ts", ".js", ".jsx")
STAND_INS = {
    ".js": (".ts", ".tsx", ".d.ts", ".js"),
    ".jsx": (".tsx", ".d.ts", ".jsx"),
    ".mjs": (".mts", ".d.mts", ".mjs"),
    ".cjs": (".cts", ".d.cts", ".cjs"),
}
AS_WRITTEN = (".ts", ".tsx", ".mts", ".cts")


def is_source(path: Column) -> Column:
    return path.rlike(rf"\.({'|'.join(SOURCE_EXTENSIONS)})$")


def completions(asked: DataFrame, written: str, exact: bool = False) -> DataFrame:
    """Rows of asked by each file that the path in column written may mean: with path, and place (first choice first).

    The ending as written is looked up in a table of endings. Paths that leave the root, or
    start at another, mean nothing. With exact, the path as it is comes too, at place -1.
    """
    clean = asked.withColumn("clean", P.normalize_path(F.col(written))).where(F.col("clean").isNotNull() & ~F.col(written).startswith("/"))
    last = F.regexp_extract(P.basename(F.col("clean")), r"^.+(\.[^.]*)$", 1)
    folder = F.col(written).rlike(r"(^|/)\.{0,2}$")
    clean = clean.withColumn("ending", F.when(folder, "/").when(last.isin(*STAND_INS), last).when(last.isin(*AS_WRITTEN), "as written").otherwise("none"))
    stem = F.when(F.col("ending").isin(*STAND_INS), F.expr("substring(clean, 1, length(clean) - length(ending))")).otherwise(F.col("clean"))
    indexes = [f"/index{e}" for e in TRIED]
    table = {**STAND_INS, "/": indexes, "as written": ("",), "none": (*TRIED, *indexes)}
    rows = [(ending, place, tail) for ending, tails in table.items() for place, tail in enumerate(tails)]
    rows += [(ending, -1, "") for ending in table if exact]
    endings = asked.sparkSession.createDataFrame(rows, "ending string, place int, tail string")
    path = F.when(F.col("place") < 0, F.col("clean")).otherwise(F.ltrim(F.concat(F.col("stem"), F.col("tail")), F.lit("/")))
    return clean.withColumn("stem", stem).join(F.broadcast(endings), "ending").select(*asked.columns, path.alias("path"), "place")


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports(file, specifier), files(path) -> every import with target, the file a relative specifier means, or null."""
    asked = imports.where(F.col("specifier").rlike(r"^\.\.?(/|$)")).select(P.dirname(F.col("file")).alias("folder"), "specifier").distinct()
    asked = asked.withColumn("written", F.when(F.col("folder") == "", F.col("specifier")).otherwise(F.concat_ws("/", "folder", "specifier")))
    found = completions(asked, "written").join(files.select("path").distinct(), "path").groupBy("folder", "specifier").agg(F.min_by("path", "place").alias("target"))
    return imports.withColumn("folder", P.dirname(F.col("file"))).join(found, ["folder", "specifier"], "left").select(*imports.columns, "target")


def nearest_folder(files: DataFrame, folders: DataFrame) -> DataFrame:
    """files(path), folders(folder) -> path, folder: the closest of the folders that hold the file ('' is the root); null if none."""
    up = files.select("path").distinct().withColumn("folder", F.explode(F.concat(F.array(F.lit("")), P.ancestors(F.col("path")))))
    best = up.join(folders.select("folder").distinct(), "folder").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    return files.join(best, "path", "left").select(*files.columns, "folder")


def sub_listing(files: DataFrame, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files in a folder ('' for all), paths relative to it, without the excluded folders in it."""
    prefix = f"{folder}/" if folder else ""
    kept = files.where(F.col("path").startswith(prefix))
    for gone in exclude:
        kept = kept.where(~F.col("path").startswith(f"{prefix}{gone}/"))
    return kept.withColumn("path", F.substring("path", len(prefix) + 1, 1 << 30))


def best_pattern(specifiers: DataFrame, patterns: DataFrame) -> DataFrame:
    """specifiers(specifier), patterns(pattern, one '*' at most) -> specifier, pattern, star: an exact pattern first, then the longest prefix.

    Of equal prefixes the longest suffix wins. star is what the '*' stands for. A specifier
    that fits none is left out. Patterns are met by an equi-join on the prefixes of the
    distinct specifiers, whose number is their length.
    """
    s = specifiers.select("specifier").distinct().where("specifier is not null")
    p = patterns.select("pattern").distinct()
    p = p.select("pattern", F.substring_index("pattern", "*", 1).alias("prefix"), F.when(F.col("pattern").contains("*"), F.substring_index("pattern", "*", -1)).alias("suffix"))
    heads = s.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length("specifier")), lambda i: F.substring(F.col("specifier"), F.lit(1), i))))
    fits = F.when(F.col("suffix").isNull(), F.col("specifier") == F.col("pattern")).otherwise(F.endswith("specifier", F.col("suffix")) & (F.length("specifier") >= F.length("prefix") + F.length("suffix")))
    rank = F.struct(F.col("suffix").isNull().alias("exact"), F.length("prefix").alias("x"), F.length("suffix").alias("y"))
    best = heads.join(p, "prefix").where(fits).groupBy("specifier").agg(F.max_by(F.struct("pattern", "prefix", "suffix"), rank).alias("p"))
    star = F.expr("substring(specifier, length(p.prefix) + 1, length(specifier) - length(p.prefix) - length(p.suffix))")
    return best.select("specifier", "p.pattern", star.alias("star"))
