"""Every problem of a declaration with the path of its place, and the projects that are sound enough for other rules.

A declaration's text is parsed to a VARIANT and walked level by level, as deep as the format goes, into a row for each
value: its path, its shape (the path with names and numbers left out) and its type. What a shape may hold is a table;
one join tells what each value breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import paths as P
from concord.plans.shared import cut, scratch, small_tasks

#: What may stand where. type: object, array, string, public (a string, an array or null); check: of a string's content.
SHAPES = [
    ("", "object", None), ("version", "string", "version"), ("$schema", "string", None), ("ignore", "array", None), ("ignore/*", "string", "item"), ("projects", "array", None), ("projects/*", "string", "folder"),
    ("groups", "object", None), ("groups/*", "object", None), ("groups/*/purpose", "string", "line"), ("groups/*/files", "array", "filled"), ("groups/*/files/*", "string", "item"),
    ("groups/*/public", "public", "file"), ("groups/*/public/*", "string", "file"), ("groups/*/dependsOn", "object", None), ("groups/*/dependsOn/*", "string", "line"),
    ("groups/*/packages", "object", None), ("groups/*/packages/*", "string", "line"), ("groups/*/external", "string", "line"),
]
REQUIRED = {"": ("version", "groups"), "groups/*": ("purpose", "files", "public", "dependsOn", "packages")}
#: Shapes whose keys are names.
NAMED = ("groups", "groups/*/dependsOn", "groups/*/packages")
VERSION = (2, 0)
GLOB = r"[*?\[\]{}!]"
PROBLEM = "struct<kind:string,path:array<string>,detail:string>"


def _node(value: Column) -> list[Column]:
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    known = F.when(kind == "OBJECT", "object").when(kind == "ARRAY", "array").when(kind == "STRING", "string").when(value.isNull() | (kind == "VOID"), "null").otherwise("other")
    keys = F.when(kind == "OBJECT", F.map_keys(value.cast("map<string,variant>")))
    items = F.when(kind == "ARRAY", F.size(value.cast("array<variant>")))
    return [known.alias("type"), F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).alias("text"), keys.alias("keys"), items.alias("items")]


def walk(declarations: DataFrame) -> DataFrame:
    """declarations(project, text) -> a row for each value: project, path, shape, key, type, text, and an object's keys or a list's number of items; texts that are no JSON have type json alone."""
    spark = declarations.sparkSession
    dealt = declarations.select("project", "text").repartition(F.xxhash64("project", "text"))  # a table may be one row group
    level = dealt.select("project", F.array().cast("array<string>").alias("path"), F.lit("").alias("shape"), F.lit(None).cast("string").alias("key"), F.try_parse_json(F.regexp_replace("text", "^\\ufeff", "")).alias("value"))
    root = level.select("project", "path", "shape", "key", F.when(F.col("value").isNull(), "json").otherwise(_node(F.col("value"))[0]).alias("type"), *_node(F.col("value"))[1:])
    out = root
    level = level.where("value is not null")
    for _ in range(max(s.count("/") for s, *_ in SHAPES) + 1):
        inner = level.select("project", "path", "shape", "value").lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("at", "name", "inner"))
        step = F.when(F.col("name").isNull() | F.col("shape").isin(*NAMED), "*").otherwise(F.col("name"))
        shape = F.when(F.col("shape") == "", step).otherwise(F.concat_ws("/", "shape", step))
        level = inner.select("project", F.concat("path", F.array(F.coalesce("name", F.col("at").cast("string")))).alias("path"), shape.alias("shape"), F.col("name").alias("key"), F.col("inner").alias("value"))
        out = out.unionByName(level.select("project", "path", "shape", "key", *_node(F.col("value"))))
        level = level.where(F.col("shape").isin(*{s.rpartition("/")[0] for s, *_ in SHAPES}))
    return out


def _content(check: Column, text: Column) -> Column:
    """What is wrong with a string's content: a kind and what was expected."""
    bad = lambda kind, expected=None: F.struct(F.lit(kind).alias("kind"), F.lit(expected).cast("string").alias("detail"))
    clean, globs = P.normalize_path(text), text.rlike(GLOB)
    place = F.when(clean.isNull() | (clean == ""), True).otherwise(False)
    return (
        F.when(check == "version", F.when(P.version_status(text, *VERSION) == "invalid", bad("invalid", "a version")))
        .when(check.isin("line", "item", "folder", "file") & text.rlike("[\r\n]"), bad("multiline"))
        .when((check == "line") & (F.trim(text) == ""), bad("empty")).when(check.isin("item", "folder", "file") & (text == ""), bad("empty"))
        .when((check == "folder") & globs, bad("invalid", "a folder without glob characters")).when((check == "folder") & place, bad("invalid", "a folder inside this project"))
        .when((check == "file") & globs, bad("invalid", "a file without glob characters")).when((check == "file") & place, bad("invalid", "a file inside this project"))
    )


def problems(declarations: DataFrame) -> DataFrame:
    """declarations(project, text) -> project, kind, path, detail.

    Kinds: json; newer, alone, of a version to come; missing and unknown-field (detail: the field); invalid (what was
    expected); empty; multiline; group-name; unknown-group; package-name (what it should be). Null texts are no JSON.
    """
    small_tasks(declarations.sparkSession)
    with scratch() as made:
        return made.keep(cut(_problems(cut(walk(declarations), "declaration-values")), "declaration-problems"))


def _problems(nodes: DataFrame) -> DataFrame:
    spark = nodes.sparkSession
    shapes = spark.createDataFrame([(s, t, c, list(REQUIRED.get(s, ()))) for s, t, c in SHAPES], "shape string, wants string, check string, needs array<string>")
    known = nodes.join(F.broadcast(shapes), "shape", "left")  # a fixed table
    names = lambda shape, name: nodes.where(F.col("shape") == shape).select("project", "path", F.col("key").alias(name))
    row = lambda df, kind, path, detail: df.select("project", F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), path.alias("path"), detail.cast("string").alias("detail"))
    none, parent = F.lit(None), F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    fits = (F.col("type") == F.col("wants")) | ((F.col("wants") == "public") & F.col("type").isin("string", "array", "null"))
    off = known.where("wants is not null and type <> 'json'").where(~fits)
    content = known.where(fits & (F.col("type") == "string")).withColumn("c", _content(F.col("check"), F.col("text"))).where("c is not null")
    # a value whose own place is not known is a field too many; what is inside of one is not looked at
    extra = known.where("wants is null and key is not null").join(F.broadcast(shapes.where("wants = 'object'").select(F.col("shape").alias("above"))), F.regexp_extract("shape", "^(.*)/[^/]*$", 1) == F.col("above"))
    # a value tells by itself which keys and items it has: nothing as large as the nodes is joined
    held = nodes.join(F.broadcast(shapes.where("size(needs) > 0").select("shape", "needs")), "shape").where("type = 'object'")
    missing = held.select("project", "path", F.explode(F.array_except("needs", "keys")).alias("need"))
    bare = known.where("type = 'array' and items = 0 and (check = 'filled' or wants = 'public')")
    group = F.col("path")[1]
    listed = nodes.where((F.col("shape") == "groups/*/public/*") & (F.col("type") == "string") & ~F.col("text").rlike(GLOB)).withColumn("file", P.normalize_path(F.col("text"))).where("file <> ''")
    again = listed.withColumn("nth", F.row_number().over(W.partitionBy("project", parent, "file").orderBy(F.try_element_at("path", F.lit(-1)).try_cast("int")))).where("nth > 1")
    out = [
        row(known.where("type = 'json'"), "json", F.col("path"), none),
        row(off, "invalid", F.col("path"), F.concat(F.lit("a value of type "), F.col("wants"))),
        row(content, F.col("c.kind"), F.col("path"), F.col("c.detail")),
        row(again, "invalid", F.col("path"), F.lit("a file that the list does not hold already")),
        row(extra, "unknown-field", parent, F.col("key")),
        row(missing, "missing", F.col("path"), F.col("need")),
        row(bare, "empty", F.col("path"), none),
        row(names("groups/*", "name").where(~F.col("name").rlike("^[a-z][a-z0-9-]*$")), "group-name", F.col("path"), F.col("name")),
        row(names("groups/*/dependsOn/*", "name").withColumn("g", group).join(names("groups/*", "name").select("project", "name"), ["project", "name"], "left_anti"), "unknown-group", F.col("path"), F.col("name")),
        row(names("groups/*/packages/*", "name").where(P.package_key(F.col("name")) != F.col("name")), "package-name", F.col("path"), P.package_key(F.col("name"))),
    ]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    newer = nodes.where((F.col("shape") == "version") & (F.col("type") == "string") & (P.version_status(F.col("text"), *VERSION) == "newer")).select("project", "text")
    return every.join(newer.select("project"), "project", "left_anti").unionByName(row(newer, "newer", F.array(F.lit("version")), F.col("text")))


def sound(frame: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of frame(project, ...) whose project has no problem: the other rules look at these alone; projects inside it are their own."""
    return frame.join(found.select("project").distinct(), "project", "left_anti")
