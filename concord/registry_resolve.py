"""Queries of specifier resolution over all tiers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.operators import specifiers
from concord.registry import MODULES, query
from concord.sources import tables as T

#: The specifier of a line, by its class c and number t.
SPECIFIER = """CASE c WHEN 0 THEN concat('../g', t % 10, '/m', t, '.js') WHEN 1 THEN concat('./../g', t % 10, '/m', t, '?raw') WHEN 2 THEN concat('@g/g', t % 10, '/m', t) WHEN 3 THEN concat('g', t % 10, '/m', t)
WHEN 4 THEN concat('g', t % 10, '/none') WHEN 5 THEN CASE t % 3 WHEN 0 THEN 'fs' WHEN 1 THEN 'fs/promises' ELSE concat('node:x', t) END WHEN 6 THEN concat('pkg', t % 12, '/sub') WHEN 7 THEN concat('@ws/w', t % 7)
WHEN 8 THEN concat('lnk', t % 5, '/x') WHEN 9 THEN concat('#in/', t % 12) WHEN 10 THEN CASE t % 3 WHEN 0 THEN '' WHEN 1 THEN '/abs' ELSE 'C:/x' END WHEN 11 THEN concat('./a', t % 12, '.css') WHEN 12 THEN 'exact' ELSE concat('m', t) END"""
ENDINGS = """(VALUES ('.js', '.ts', 0), ('.js', '.tsx', 1), ('.js', '.d.ts', 2), ('.js', '.js', 3), ('', '.ts', 0), ('', '.tsx', 1), ('', '.d.ts', 2), ('', '.js', 3), ('', '.jsx', 4), ('', '/index.ts', 5)) AS v(written, ending, place)"""


@query(f"""WITH {MODULES}, i AS (SELECT DISTINCT l_partkey % 10 AS g, 'src/g' || (l_partkey % 10) || '/m' || l_partkey || '.ts' AS file, (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 14 AS c, l_suppkey * 3 + l_linenumber AS t FROM lineitem),
s AS (SELECT *, {SPECIFIER} AS specifier, g % 2 = 1 OR g % 3 = 0 AS based FROM i),
w AS (SELECT g, specifier, 0 AS nth, 'src/g' || (t % 10) || '/m' || t AS stem, CASE c WHEN 0 THEN '.js' ELSE '' END AS written FROM s WHERE c IN (0, 1)
UNION SELECT g, specifier, CASE WHEN g % 2 = 1 THEN 1 ELSE 0 END, CASE WHEN g % 2 = 1 AND t % 10 = 3 THEN 'src/g4/m' || t ELSE 'src/g' || (t % 10) || '/m' || t END, '' FROM s WHERE c = 2
UNION SELECT g, specifier, 2, 'src/' || specifier, '' FROM s WHERE c = 3 AND based
UNION SELECT g, specifier, 0, 'src/g1/m1', '' FROM s WHERE c = 12 AND g % 2 = 1
UNION SELECT g, specifier, 0, 'src/g5/' || specifier, '' FROM s WHERE c = 13 AND g % 2 = 0),
h AS (SELECT g, specifier, min_by(path, nth * 10 + place) AS path FROM w JOIN {ENDINGS} USING (written) JOIN m ON m.path = stem || ending GROUP BY g, specifier)
SELECT DISTINCT s.file, s.specifier,
CASE WHEN h.path IS NOT NULL THEN 'file' WHEN c < 2 THEN 'relative' WHEN c = 2 THEN 'paths' WHEN c IN (3, 4) THEN CASE WHEN NOT based OR t % 10 = 7 OR (t % 10 = 8 AND g = 1) THEN 'package' ELSE 'paths' END WHEN c = 5 THEN 'builtin'
WHEN c = 7 AND t % 7 < 5 THEN CASE WHEN t % 7 = g % 5 AND g % 2 = 0 THEN 'file' ELSE 'workspace' END WHEN c = 8 AND t % 5 % 2 = 0 THEN 'workspace' WHEN c = 9 AND t % 12 = g THEN 'file' WHEN c IN (9, 10) THEN 'other'
WHEN c = 11 THEN CASE WHEN t % 12 % 10 = g THEN 'other' ELSE 'relative' END ELSE 'package' END AS kind,
CASE WHEN h.path IS NOT NULL THEN h.path WHEN c IN (3, 4) AND (NOT based OR t % 10 = 7 OR (t % 10 = 8 AND g = 1)) THEN 'g' || (t % 10) WHEN c = 5 THEN s.specifier WHEN c = 6 THEN 'pkg' || (t % 12) WHEN c = 7 AND t % 7 >= 5 THEN s.specifier
WHEN c = 7 AND t % 7 = g % 5 AND g % 2 = 0 THEN 'src/g2/m2.d.ts' WHEN c = 8 AND t % 5 % 2 = 1 THEN 'lnk' || (t % 5) WHEN c = 9 AND t % 12 = g THEN 'src/g1/m1.tsx' WHEN c IN (12, 13) THEN s.specifier END AS target,
CASE WHEN c = 2 AND h.path IS NULL THEN CASE WHEN g % 2 = 1 AND t % 10 = 3 THEN '@g/g3/*' ELSE '@g/*' END END AS pattern
FROM s LEFT JOIN h USING (g, specifier)""")
def resolved_tiers(spark, sf):
    """Every line's specifier through all tiers: relative, pattern, base folder, runtime, workspace, link and package."""
    l = T.table(spark, sf, "lineitem").selectExpr("l_partkey AS p", "(l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 14 AS c", "l_suppkey * 3 + l_linenumber AS t")
    imports = l.selectExpr("concat('src/g', p % 10, '/m', p, '.ts') AS file", f"{SPECIFIER} AS specifier").distinct()
    nation = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"))
    listing = T.modules(spark, sf).selectExpr("path", "true AS listed").unionByName(nation.selectExpr("concat('src/g', n % 10, '/a', n, '.css') AS path", "false AS listed"))
    own = nation.where("n < 10 and n % 2 = 0")
    settings = own.selectExpr("concat('src/g', n) AS folder", "CASE WHEN n % 3 = 0 THEN 'src' END AS base").unionByName(nation.where("n = 1").selectExpr("'src' AS folder", "'src' AS base"))
    patterns = own.selectExpr("concat('src/g', n) AS settings", "stack(2, '@g/*', 0, array('src/*', 'lib/*'), '*', 1, array('src/g5/*')) AS (pattern, position, targets)")
    patterns = patterns.unionByName(nation.where("n = 1").selectExpr("'src' AS settings", "stack(3, '@g/*', 0, array('lib/*', 'src/*'), '@g/g3/*', 1, array('src/g4/*'), 'exact', 2, array('src/g1/m1')) AS (pattern, position, targets)"))
    packages = T.table(spark, sf, "supplier").selectExpr("concat('packages/w', s_suppkey % 7) AS folder", "concat('@ws/w', s_suppkey % 7) AS name").distinct()
    installed = nation.where("n in (7, 8)").selectExpr("CASE n WHEN 7 THEN 'src' ELSE 'src/g1' END AS folder", "concat('g', n) AS name")
    linked = T.table(spark, sf, "region").where("r_regionkey % 2 = 0").selectExpr("concat('lnk', r_regionkey) AS name")
    answers = nation.where("n < 10").selectExpr("concat('src/g', n) AS folder", "stack(2, concat('#in/', n), 'src/g1/m1.tsx', concat('@ws/w', n % 5), CASE WHEN n % 2 = 0 THEN 'src/g2/m2.d.ts' ELSE 'gone.ts' END) AS (specifier, target)")
    workspaces = specifiers.workspaces(packages, ["packages/*", "!packages/w5", "!packages/w6"])
    return specifiers.resolve(imports, listing, settings, patterns, workspaces, installed, linked, answers)
