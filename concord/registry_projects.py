"""Queries of projects within projects and of the plan of re-exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.operators import declarations, fixes, projects
from concord.registry import DECLARED, EDGES, FILES, query
from concord.sources import tables as T

FOLDERS = f"{FILES}, u AS (SELECT DISTINCT split_part(path, '/', 1) AS project, regexp_extract(path, '^[^/]*/(.*)/[^/]*$', 1) AS folder FROM f), h AS (SELECT * FROM u WHERE length(folder) % 3 = 0 AND folder <> '')"


def _folders(spark, sf):
    """Folders of each host's pages as found declarations, and those that the host declares."""
    found = T.page_files(spark, sf).select(F.substring_index("path", "/", 1).alias("project"), F.regexp_extract("path", "^[^/]*/(.*)/[^/]*$", 1).alias("folder")).distinct()
    return found, found.where("length(folder) % 3 = 0 and folder <> ''")


@query(f"WITH {FOLDERS} SELECT project, folder FROM u WHERE folder <> '' AND NOT contains(folder, '1') AND NOT EXISTS (SELECT 1 FROM h WHERE h.project = u.project AND (h.folder = u.folder OR starts_with(u.folder, h.folder || '/')))")
def undeclared_projects(spark, sf):
    found, declared = _folders(spark, sf)
    return projects.undeclared_projects(found, declared, F.col("path").contains("1"))


@query(f"WITH {FOLDERS}, p AS (SELECT project || '/' || folder AS folder FROM h) SELECT path, (SELECT max_by(folder, length(folder)) FROM p WHERE starts_with(path, folder || '/')) AS project FROM f")
def assigned_projects(spark, sf):
    _, declared = _folders(spark, sf)
    return projects.assign(T.page_files(spark, sf), declared.select(F.concat_ws("/", "project", "folder").alias("project")))


@query("WITH p AS (SELECT DISTINCT o_custkey AS project, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS position FROM orders), l AS (SELECT project, min(position) AS position FROM p GROUP BY project) SELECT o_custkey AS project, o_orderkey AS key FROM orders JOIN l ON project = o_custkey AND position = CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END")
def united_projects(spark, sf):
    o = T.table(spark, sf, "orders")
    checks = [o.where(where).selectExpr("o_custkey AS project", "o_orderkey AS key") for where in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'")]
    covered = o.selectExpr("CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS position", "o_custkey AS project").distinct()
    return projects.united(checks, covered)


#: Private imports of declared pairs by the group that is imported, and what its public file shows already.
PRIVATE = f"""{EDGES}, {DECLARED}, n AS (SELECT e.dst AS grp, row_number() OVER (PARTITION BY e.dst ORDER BY file, line) AS place, 's' || target || '.ts' AS target, name, line % 2 = 0 AS as_type FROM e WHERE target % 3 <> 0 AND EXISTS (SELECT 1 FROM d WHERE d.src = e.src AND d.dst = e.dst)),
x AS (SELECT DISTINCT p_size AS grp, p_brand AS shown, 's' || (p_size * 3 + 1) || '.ts' AS target, p_size % 2 = 0 AS typed FROM part WHERE p_size < 25 AND p_partkey % 3 = 0),
y AS (SELECT n.*, x.shown IS NOT NULL AS there, x.shown IS NOT NULL AND (x.target <> n.target OR (typed AND NOT as_type)) AS clash FROM n LEFT JOIN x ON x.grp = n.grp AND x.shown = n.name),
z AS (SELECT *, arg_min(CASE WHEN NOT there THEN target END, place) OVER (PARTITION BY grp, name) AS first FROM y)"""


def _plan(spark, sf):
    e = T.edges(spark, sf).where("target % 3 <> 0").join(T.declared(spark, sf), ["src", "dst"], "left_semi")
    place = F.row_number().over(W.partitionBy("dst").orderBy("file", "line"))
    names = F.array(F.struct("name", F.expr("line % 2 = 0").alias("as_type")))
    imports = e.select(F.col("dst").alias("grp"), place.alias("place"), F.expr("concat('s', target, '.ts')").alias("target"), names.alias("names"))
    exported = T.table(spark, sf, "part").where("p_size < 25 and p_partkey % 3 = 0").selectExpr("p_size AS grp", "p_brand AS shown", "concat('s', p_size * 3 + 1, '.ts') AS target", "p_brand AS name", "p_size % 2 = 0 AS type_only").distinct()
    return fixes.plan(imports, exported)


@query(f"WITH {PRIVATE} SELECT grp, name AS shown, target, name, bool_and(as_type) AS type_only FROM z WHERE NOT there AND target = first GROUP BY grp, name, target")
def reexport_plan(spark, sf):
    return _plan(spark, sf)[0]


@query(f"WITH {PRIVATE} SELECT grp, CASE WHEN clash THEN 'exported' WHEN NOT there AND target <> first THEN 'planned' ELSE 'routed' END AS fate, count(*) AS n FROM z GROUP BY ALL")
def reexport_fates(spark, sf):
    return _plan(spark, sf)[1].groupBy("grp", "fate").agg(F.count("*").alias("n"))


#: A declaration for each part, broken in one way of twelve.
DECLARATION = """concat('{"version":"2.0","groups":{"g', p_partkey % 7, '":{"purpose":"P","files":["a/**"],"public":"a/i.ts","dependsOn":{"h":"why"},"packages":{}},"h":{"purpose":"Q","files":["b"],"public":null,"dependsOn":{},"packages":{}}}}')"""
BROKEN = [("}}}}", "}}}"), ("2.0", "9.1"), ("2.0", "x"), ('"purpose":"Q",', ""), ('"purpose":"Q"', '"purpose":"Q","odd":1'), ('["b"]', "[]"), ('"P"', '"P\\nQ"'), ('"h":{', '"H!":{'), ('"packages":{}', '"packages":{"fs":"r"}'), ('"public":null', '"public":["a.ts","./a.ts","b*"]'), ('"dependsOn":{}', '"dependsOn":5')]
CASES = [
    (1, "json", "''", "NULL"), (2, "newer", "'version'", "'9.1'"), (3, "invalid", "'version'", "'a version'"), (4, "missing", "'groups/h'", "'purpose'"), (5, "unknown-field", "'groups/h'", "'odd'"), (6, "empty", "'groups/h/files'", "NULL"),
    (7, "multiline", "'groups/g' || p_partkey % 7 || '/purpose'", "NULL"), (8, "group-name", "'groups/H!'", "'H!'"), (8, "unknown-group", "'groups/g' || p_partkey % 7 || '/dependsOn/h'", "'h'"),
    (9, "package-name", "'groups/h/packages/fs'", "'node:fs'"), (9, "package-name", "'groups/g' || p_partkey % 7 || '/packages/fs'", "'node:fs'"),
    (10, "invalid", "'groups/h/public/1'", "'a file that the list does not hold already'"), (10, "invalid", "'groups/h/public/2'", "'a file without glob characters'"), (11, "invalid", "'groups/h/dependsOn'", "'a value of type object'"),
]


def _declarations(spark, sf):
    text = F.expr(DECLARATION)
    for k, (was, now) in enumerate(BROKEN, 1):
        text = F.when(F.col("p_partkey") % 12 == k, F.replace(F.expr(DECLARATION), F.lit(was), F.lit(now))).otherwise(text)
    return T.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("project"), text.alias("text"))


@query(" UNION ALL ".join(f"SELECT CAST(p_partkey AS VARCHAR) AS project, '{kind}' AS kind, {path} AS path, {detail} AS detail FROM part WHERE p_partkey % 12 = {k}" for k, kind, path, detail in CASES))
def declaration_problems(spark, sf):
    return declarations.problems(_declarations(spark, sf)).select("project", "kind", F.array_join("path", "/").alias("path"), "detail")


@query("SELECT CAST(p_partkey AS VARCHAR) AS project, p_size FROM part WHERE p_partkey % 12 = 0")
def sound_projects(spark, sf):
    frame = T.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("project"), "p_size")
    return declarations.sound(frame, declarations.problems(_declarations(spark, sf)))
