"""All queries of the engine, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import paths as P
from concord.operators import components, diff, graph, ownership, relations, reports, resolve, rollup, stats
from concord.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EDGES = """e AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_orderkey AS file, l_linenumber AS line, l_suppkey AS target, p_brand AS name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def pairs_sql(name: str, rule: str) -> str:
    return f"{name} AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey AND {rule.replace('src', 'a.n_nationkey').replace('dst', 'b.n_nationkey')})"


DECLARED = "d AS (SELECT n_nationkey AS src, x.dst FROM nation, (SELECT unnest(range(28))::INT AS dst) x WHERE n_nationkey <> x.dst AND (n_nationkey * 7 + x.dst * 3) % 5 < 3)"
SPARSE = pairs_sql("g", "(src * 7 + dst * 5) % 23 < 2")
ACYCLIC = pairs_sql("g", "src > dst AND (src * 7 + dst * 5) % 11 < 2")
FILES = "f AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {EDGES}, {DECLARED} SELECT src, dst, count(*) AS imports, min((file, line))[1] AS first_file, min((file, line))[2] AS first_line FROM e WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM d WHERE d.src = e.src AND d.dst = e.dst) GROUP BY src, dst")
def undeclared_pairs(spark, sf):
    return relations.undeclared(T.edges(spark, sf), T.declared(spark, sf))


@query(f"WITH {EDGES}, {DECLARED} SELECT src, dst FROM d EXCEPT SELECT src, dst FROM e")
def unused_declared(spark, sf):
    return relations.unused(T.edges(spark, sf), T.declared(spark, sf))


@query(f"WITH {EDGES}, {DECLARED} SELECT src, dst FROM d WHERE src NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) EXCEPT SELECT src, dst FROM e")
def unused_declared_held(spark, sf):
    held = T.table(spark, sf, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("src"))
    return relations.unused(T.edges(spark, sf), T.declared(spark, sf), held)


@query(f"WITH {EDGES}, {DECLARED}, c AS (SELECT src, dst, count(*) AS n FROM e WHERE src <> dst GROUP BY ALL) SELECT src, dst, CASE WHEN c.n IS NULL THEN 'unused' WHEN d.src IS NULL THEN 'undeclared' ELSE 'used' END AS state, coalesce(n, 0) AS imports FROM d FULL JOIN c USING (src, dst)".replace("d.src IS NULL", "NOT EXISTS (SELECT 1 FROM d x WHERE x.src = src AND x.dst = dst)").replace("SELECT src, dst, CASE", "SELECT coalesce(d.src, c.src) AS src, coalesce(d.dst, c.dst) AS dst, CASE").replace("NOT EXISTS (SELECT 1 FROM d x WHERE x.src = src AND x.dst = dst)", "d.src IS NULL").replace("USING (src, dst)", "ON d.src = c.src AND d.dst = c.dst"))
def edge_state(spark, sf):
    return relations.edge_state(T.edges(spark, sf), T.declared(spark, sf))


@query(f"WITH {EDGES} SELECT src, dst, count(*) AS imports, min((file, line))[1] AS first_file, min((file, line))[2] AS first_line FROM e WHERE src <> dst GROUP BY src, dst")
def pair_counts(spark, sf):
    return relations.pair_counts(T.edges(spark, sf))


@query(f"WITH {EDGES} SELECT src AS grp, name AS package, count(*) AS uses FROM e WHERE (src * 3 + CAST(regexp_extract(name, '[0-9]+') AS INT)) % 4 >= 2 GROUP BY ALL")
def package_undeclared(spark, sf):
    e = T.edges(spark, sf).select(F.col("src").alias("grp"), F.col("name").alias("package"))
    listed = e.distinct().where("(grp * 3 + cast(regexp_extract(package, '[0-9]+', 0) as int)) % 4 < 2")
    return relations.undeclared_keys(e, listed, ["grp", "package"])


@query(f"WITH {EDGES}, l AS (SELECT n_nationkey AS grp, p_brand AS package FROM nation, (SELECT p_brand FROM part UNION SELECT 'Brand#99') WHERE (n_nationkey * 3 + CAST(regexp_extract(p_brand, '[0-9]+') AS INT)) % 4 < 2) SELECT * FROM l EXCEPT SELECT src, name FROM e")
def package_unused(spark, sf):
    listed = T.brands(spark, sf, "Brand#99").toDF("package").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(24)))).where("(grp * 3 + cast(regexp_extract(package, '[0-9]+', 0) as int)) % 4 < 2")
    return listed.join(T.edges(spark, sf).select(F.col("src").alias("grp"), F.col("name").alias("package")).distinct(), ["grp", "package"], "left_anti").select("grp", "package")


@query(f"WITH {DECLARED}, r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM d) SELECT dst, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS dependents FROM r WHERE k <= 3 GROUP BY dst")
def top3_dependents(spark, sf):
    return relations.top_dependents(T.declared(spark, sf))


@query(f"WITH {EDGES}, {DECLARED}, s AS (SELECT src, dst, file, line % 2 AS line, target % 5 AS target, arg_min(name, (e.line, name)) AS name FROM e WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM d) GROUP BY src, dst, file, e.line % 2, target % 5) SELECT src, dst, count(*) AS statements, count(DISTINCT target) AS targets, min(name) AS least_name FROM s GROUP BY src, dst")
def imports_grouped(spark, sf):
    statements = T.edges(spark, sf).selectExpr("src", "dst", "file", "line % 2 AS line", "line AS stmt", "target % 5 AS target", "name")
    return relations.grouped_imports(statements, T.declared(spark, sf))


@query(f"WITH {EDGES}, {DECLARED} SELECT src, dst, target, count(*) AS imports, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM e WHERE src <> dst AND (src, dst) IN (SELECT (src, dst) FROM d) AND target % 3 <> 0 GROUP BY src, dst, target")
def private_imports(spark, sf):
    public = T.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("target"))
    return relations.private_imports(T.edges(spark, sf), T.declared(spark, sf), public)


@query(f"WITH {EDGES} SELECT s_suppkey AS target, p_brand AS name FROM supplier, (SELECT p_brand FROM part UNION SELECT 'default') WHERE s_suppkey % 3 = 0 EXCEPT SELECT target, name FROM e WHERE src <> dst")
def export_unused(spark, sf):
    public = T.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("target"))
    exports = public.crossJoin(F.broadcast(T.brands(spark, sf, "default")))  # every public file exports the same few names
    return relations.unused_exports(exports, T.edges(spark, sf))


MODULES = "m AS (SELECT p_partkey AS k, 'src/g' || (p_partkey % 10) || '/m' || p_partkey || CASE p_partkey % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.d.ts' WHEN 3 THEN '.js' WHEN 4 THEN '.jsx' ELSE '/index.ts' END AS path FROM part)"


@query(f"""WITH {MODULES}, i AS (SELECT DISTINCT l_partkey, 'src/g' || (l_partkey % 10) || '/m' || l_partkey || '.ts' AS file, l_suppkey * 3 + l_linenumber AS t FROM lineitem),
w AS (SELECT DISTINCT file, 'src/g' || (t % 10) || '/m' || t AS stem, CASE t % 4 WHEN 0 THEN '.js' WHEN 1 THEN '' WHEN 2 THEN '.ts' ELSE '.jsx' END AS written, '../g' || (t % 10) || '/m' || t || CASE t % 4 WHEN 0 THEN '.js' WHEN 1 THEN '' WHEN 2 THEN '.ts' ELSE '.jsx' END AS specifier FROM i),
c AS (SELECT * FROM (VALUES ('.js', '.ts', 0), ('.js', '.tsx', 1), ('.js', '.d.ts', 2), ('.js', '.js', 3), ('.jsx', '.tsx', 0), ('.jsx', '.d.ts', 1), ('.jsx', '.jsx', 2), ('.ts', '.ts', 0), ('', '.ts', 0), ('', '.tsx', 1), ('', '.d.ts', 2), ('', '.js', 3), ('', '.jsx', 4), ('', '/index.ts', 5)) AS v(written, ending, place)),
h AS (SELECT file, specifier, min_by(path, place) AS target FROM w JOIN c USING (written) JOIN m ON path = stem || ending GROUP BY ALL)
SELECT w.file, w.specifier, h.target FROM w LEFT JOIN h ON w.file = h.file AND w.specifier = h.specifier""")
def resolved_imports(spark, sf):
    l = T.table(spark, sf, "lineitem").selectExpr("l_partkey", "l_suppkey * 3 + l_linenumber AS t")
    imports = l.selectExpr(
        "concat('src/g', l_partkey % 10, '/m', l_partkey, '.ts') AS file",
        "concat('../g', t % 10, '/m', t, CASE t % 4 WHEN 0 THEN '.js' WHEN 1 THEN '' WHEN 2 THEN '.ts' ELSE '.jsx' END) AS specifier",
    ).distinct()
    return resolve.resolve_relative(imports, T.modules(spark, sf))


@query(f"WITH {MODULES}, d AS (SELECT 'src/g' || n_nationkey AS folder FROM nation WHERE n_nationkey % 3 = 0 UNION SELECT 'src' UNION SELECT path[:-10] FROM m WHERE path LIKE '%/index.ts' AND k % 5 = 0) SELECT path, (SELECT max_by(folder, length(folder)) FROM d WHERE starts_with(path, folder || '/')) AS folder FROM m")
def nearest_settings(spark, sf):
    m = T.modules(spark, sf)
    of_groups = T.table(spark, sf, "nation").where("n_nationkey % 3 = 0").selectExpr("concat('src/g', n_nationkey) AS folder")
    of_modules = m.where("path like '%/index.ts' and k % 5 = 0").selectExpr("substring(path, 1, length(path) - 9) AS folder")
    return resolve.nearest_folder(m.select("path"), of_groups.unionByName(of_modules).unionByName(spark.createDataFrame([("src",)], "folder string")))


@query(f"WITH {MODULES} SELECT substr(path, 5) AS path FROM m WHERE path NOT LIKE 'src/g3/%' AND path NOT LIKE 'src/g7/%'")
def sub_listing(spark, sf):
    return resolve.sub_listing(T.modules(spark, sf).select("path"), "src", ("g3", "g7"))


@query("WITH s AS (SELECT DISTINCT '@' || lower(p_brand) || '/' || replace(p_name, ' ', '/') AS specifier FROM part), p AS (SELECT pattern, split_part(pattern, '*', 1) AS a, CASE WHEN contains(pattern, '*') THEN split_part(pattern, '*', 2) END AS b FROM (VALUES ('@*'), ('@brand#1*'), ('@brand#12/*'), ('@brand#2*1'), ('*')) AS v(pattern)), r AS (SELECT specifier, pattern, a, b, row_number() OVER (PARTITION BY specifier ORDER BY b IS NULL DESC, length(a) DESC, length(b) DESC) AS k FROM s JOIN p ON CASE WHEN b IS NULL THEN specifier = pattern ELSE starts_with(specifier, a) AND suffix(specifier, b) AND length(specifier) >= length(a) + length(b) END) SELECT specifier, pattern, substr(specifier, length(a) + 1, length(specifier) - length(a) - length(b)) AS star FROM r WHERE k = 1")
def path_patterns(spark, sf):
    s = T.table(spark, sf, "part").selectExpr("concat('@', lower(p_brand), '/', replace(p_name, ' ', '/')) AS specifier")
    return resolve.best_pattern(s, spark.createDataFrame([("@*",), ("@brand#1*",), ("@brand#12/*",), ("@brand#2*1",), ("*",)], "pattern string"))


@query("WITH l AS (SELECT s_suppkey AS file, n_nationkey AS owner, (n_nationkey * 7 + s_suppkey) % 25 AS pos FROM supplier, nation WHERE (s_suppkey + n_nationkey) % 4 = 0), o AS (SELECT s_suppkey AS file, s_nationkey AS a, (s_nationkey + 4) % 25 AS b FROM supplier), r AS (SELECT l.file, owner, row_number() OVER (PARTITION BY l.file ORDER BY pos) AS k FROM l JOIN o ON l.file = o.file AND owner IN (a, b)) SELECT file, owner FROM r WHERE k = 1")
def public_first_owner(spark, sf):
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"), "s_nationkey")
    listed = s.select("file", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("owner")).where("(file + owner) % 4 = 0").withColumn("pos", F.expr("(owner * 7 + file) % 25"))
    owned = s.select("file", F.explode(F.array("s_nationkey", F.expr("(s_nationkey + 4) % 25"))).alias("owner"))
    return relations.first_listed(listed, owned)


GLOBS = [("com", "*.example.com/**"), ("com", "!*.example.com/fr/**"), ("en", "**/en/*"), ("net", "*.example.{net,org}/**"), ("net", "!**/en/1*"), ("net", "**/en/1[0-4]*"), ("none", "docs/**"), (None, "**/es/**"), (None, "!**/es/[0-9]"), (None, "**/e?/99?")]
#: The same globs as expressions, written by hand.
GLOB_SQL = (
    "m AS (SELECT path, glob_id, owner, negative, literal FROM f, (VALUES "
    "(0, 'com', FALSE, 0, '^[^/]*\\.example\\.com/.*$'), (1, 'com', TRUE, 1, '^[^/]*\\.example\\.com/fr/.*$'), (2, 'en', FALSE, 1, '^([^/]+/)*en/[^/]*$'), "
    "(3, 'net', FALSE, 0, '^[^/]*\\.example\\.(net|org)/.*$'), (4, 'net', TRUE, 1, '^([^/]+/)*en/1[^/]*$'), (5, 'net', FALSE, 1, '^([^/]+/)*en/1[0-4][^/]*$'), (6, 'none', FALSE, 1, '^docs/.*$'), "
    "(7, NULL, FALSE, 1, '^([^/]+/)*es/.*$'), (8, NULL, TRUE, 1, '^([^/]+/)*es/[0-9]$'), (9, NULL, FALSE, 0, '^([^/]+/)*e[^/]/99[^/]$')) g(glob_id, owner, negative, literal, rx) WHERE regexp_matches(path, rx)), "
    "w AS (SELECT *, row_number() OVER (PARTITION BY path, owner ORDER BY glob_id DESC) = 1 AS last, NOT negative OR coalesce(NOT lag(negative) OVER (PARTITION BY path, owner ORDER BY glob_id), FALSE) AS counts FROM m), "
    "i AS (SELECT DISTINCT path FROM w WHERE owner IS NULL AND last AND NOT negative), "
    "k AS (SELECT * FROM w WHERE owner IS NULL OR path NOT IN (SELECT path FROM i)), "
    "p AS (SELECT path, string_agg(owner, ',' ORDER BY literal, owner) AS owners, count(owner) AS n FROM k WHERE last AND NOT negative GROUP BY path), "
    "o AS (SELECT f.path, CASE WHEN f.path IN (SELECT path FROM i) THEN 'ignored' WHEN n > 1 THEN 'overlap' WHEN n = 1 THEN 'owned' ELSE 'unowned' END AS state, coalesce(owners, '') AS owners FROM f LEFT JOIN p ON f.path = p.path)"
)


@query(f"WITH {FILES}, {GLOB_SQL} SELECT path, state, CASE WHEN state = 'owned' THEN owners END AS owner, owners FROM o")
def ownership_last_match(spark, sf):
    return ownership.owners(T.page_files(spark, sf), ownership.glob_table(spark, GLOBS))


@query(f"WITH {FILES}, {GLOB_SQL}, ids AS (SELECT unnest(range(10))::INT AS glob_id) SELECT ids.glob_id, count(path) AS hits FROM ids LEFT JOIN (SELECT * FROM k WHERE counts) x ON ids.glob_id = x.glob_id GROUP BY ids.glob_id")
def glob_hits(spark, sf):
    return ownership.glob_hits(T.page_files(spark, sf), ownership.glob_table(spark, GLOBS)).select("glob_id", "hits")


@query(f"WITH {FILES}, {GLOB_SQL}, ids AS (SELECT unnest(range(10))::INT AS glob_id) SELECT glob_id FROM ids WHERE glob_id NOT IN (SELECT glob_id FROM k WHERE counts)")
def glob_empty(spark, sf):
    return glob_hits(spark, sf).where("hits = 0").select("glob_id")


@query(f"WITH {FILES}, {GLOB_SQL} SELECT state, count(*) AS n FROM o GROUP BY state")
def owner_counts(spark, sf):
    return ownership_last_match(spark, sf).groupBy("state").agg(F.count("*").alias("n"))


@query(f"WITH {FILES}, {GLOB_SQL}, t AS (SELECT count(*) AS total FROM f), h AS (SELECT glob_id, count(*) AS hits FROM k WHERE counts AND owner IS NULL AND NOT negative GROUP BY glob_id) SELECT glob_id, hits, total FROM h, t WHERE hits > 0.05 * total")
def ignore_large_share(spark, sf):
    globs = ownership.glob_table(spark, GLOBS)
    hits = ownership.glob_hits(T.page_files(spark, sf), globs).join(globs.where("owner is null and not negative").select("glob_id"), "glob_id", "left_semi")
    return rollup.share_over(hits.select("glob_id", "hits"), T.page_files(spark, sf).count(), 0.05)


FOLDERS = "u AS (SELECT path, flag, unnest(range(1, len(string_split(path, '/'))))::INT AS k FROM (SELECT path, path LIKE '%/en/%' AS flag FROM f)), a AS (SELECT array_to_string(string_split(path, '/')[1:k], '/') AS folder, CASE WHEN k + 1 < len(string_split(path, '/')) THEN array_to_string(string_split(path, '/')[1:k + 1], '/') END AS below, flag FROM u), r AS (SELECT folder, count(*) AS total, CAST(sum(flag::INT) AS BIGINT) AS flagged, count(DISTINCT below) AS subfolders FROM a GROUP BY folder)"


def _flagged(spark, sf):
    return T.page_files(spark, sf).withColumn("flag", F.col("path").contains("/en/"))


@query(f"WITH {FILES}, {FOLDERS} SELECT * FROM r")
def folder_rollup(spark, sf):
    return rollup.folder_rollup(_flagged(spark, sf))


TOPMOST = """tops AS (SELECT DISTINCT string_split(path, '/')[1] AS top FROM f WHERE path LIKE '%/en/%' AND path LIKE '%/%'),
v AS (SELECT path, path LIKE '%/en/%' AS flag FROM f WHERE path LIKE '%/%' AND string_split(path, '/')[1] IN (SELECT top FROM tops)),
u AS (SELECT path, flag, unnest(range(1, len(string_split(path, '/'))))::INT AS k FROM v),
a AS (SELECT path, flag, k, array_to_string(string_split(path, '/')[1:k], '/') AS folder, CASE WHEN k + 1 < len(string_split(path, '/')) THEN array_to_string(string_split(path, '/')[1:k + 1], '/') END AS below FROM u),
r AS (SELECT folder, any_value(k) AS k, count(*) AS total, count(*) FILTER (flag) AS bad, count(DISTINCT below) AS subs FROM a GROUP BY folder),
x AS (SELECT a.path, a.k, r.folder, r.total, r.bad, r.subs > 0 AS has, r.k = 1 OR r.total * 2 > (SELECT count(*) FROM v) AS base, a.k > 1 AND lag(r.subs) OVER w = 1 AS only_child FROM a JOIN r USING (folder) WHERE flag WINDOW w AS (PARTITION BY a.path ORDER BY a.k)),
y AS (SELECT *, sum(CASE WHEN only_child THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY k) AS chain FROM x),
z AS (SELECT *, has AND bool_or(base) OVER (PARTITION BY path, chain ORDER BY k) AS skipped FROM y),
t AS (SELECT path, min_by(folder, k) AS folder, min_by(bad, k) AS bad FROM z WHERE total = bad AND NOT skipped GROUP BY path)"""


@query(f"WITH {FILES}, {TOPMOST} SELECT DISTINCT CASE WHEN bad >= 3 THEN folder || '/**' ELSE f.path END AS at, CASE WHEN bad >= 3 THEN bad END AS n FROM f LEFT JOIN t USING (path) WHERE f.path LIKE '%/en/%'")
def unowned_topmost(spark, sf):
    return rollup.group_unowned(_flagged(spark, sf), 3)


@query(f"WITH {FILES}, {GLOB_SQL} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, CASE WHEN state = 'owned' THEN owners END AS owner, count(*) AS n FROM o GROUP BY ALL")
def files_by_folder_and_owner(spark, sf):
    return rollup.by_folder_and_owner(ownership_last_match(spark, sf))


REACH = "r(src, dst) AS (SELECT src, dst FROM g UNION SELECT r.src, g.dst FROM r JOIN g ON r.dst = g.src)"


@query(f"WITH RECURSIVE {SPARSE}, {REACH} SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src AND a.src <> a.dst GROUP BY a.src")
def cycle_members(spark, sf):
    return graph.strong_components(graph.closure(T.sparse(spark, sf)))


#: No shortest path of this graph has more than 6 steps; the operator has no such bound.
PATHS = "p(start, dst, path, k) AS (SELECT s, s, [s], 0 FROM s UNION ALL SELECT start, g.dst, list_append(path, g.dst), k + 1 FROM p JOIN g ON p.dst = g.src WHERE k < 6 AND NOT list_contains(path[2:], g.dst) AND (k = 0 OR p.dst <> start)), b AS (SELECT start, dst, min((k, path)) AS x FROM p WHERE k > 0 GROUP BY start, dst)"


@query(f"WITH RECURSIVE {SPARSE}, s AS (SELECT n_nationkey AS s FROM nation WHERE n_nationkey < 3), {PATHS} SELECT start, dst, array_to_string(x[2], '>') AS path FROM b")
def reverse_path(spark, sf):
    starts = T.table(spark, sf, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("start"))
    return graph.shortest_paths(T.sparse(spark, sf), starts).select("start", "dst", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH RECURSIVE {SPARSE}, {REACH}, c AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src AND a.src <> a.dst GROUP BY a.src), s AS (SELECT DISTINCT component AS s FROM c), {PATHS} SELECT start AS component, array_to_string(x[2], '>') AS path FROM b WHERE start = dst")
def cycle_representative(spark, sf):
    return graph.representative_cycles(T.sparse(spark, sf)).select("component", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH {ACYCLIC}, a AS (SELECT dst FROM g WHERE src = 24), b AS (SELECT g.dst FROM a JOIN g ON a.dst = g.src) SELECT node, min(level) AS level FROM (SELECT 24 AS node, 0 AS level UNION ALL SELECT dst, 1 FROM a UNION ALL SELECT dst, 2 FROM b) GROUP BY node")
def reach_depth_2(spark, sf):
    return graph.reach_within(T.acyclic(spark, sf), spark.createDataFrame([(24,)], "node int"), 2)


@query(f"WITH RECURSIVE {ACYCLIC}, {REACH} SELECT dst AS node FROM r WHERE src = 24 AND dst IN (SELECT src FROM r WHERE dst = 1) UNION SELECT unnest([24, 1]) WHERE EXISTS (SELECT 1 FROM r WHERE src = 24 AND dst = 1)")
def paths_between(spark, sf):
    return graph.between(graph.closure(T.acyclic(spark, sf)), 24, 1)


@query(f"WITH RECURSIVE {ACYCLIC}, p(dst, path) AS (SELECT dst, [24, dst] FROM g WHERE src = 24 UNION ALL SELECT g.dst, list_append(path, g.dst) FROM p JOIN g ON p.dst = g.src WHERE p.dst <> 1), w AS (SELECT path, row_number() OVER (ORDER BY len(path), path) AS place, count(*) OVER () > 8 AS more FROM p WHERE dst = 1) SELECT array_to_string(path, '>') AS path, place, more FROM w WHERE place <= 8")
def simple_paths(spark, sf):
    """The report's list: the first 8 here, and whether there are more."""
    return graph.path_list(graph.simple_paths(T.acyclic(spark, sf), 24, 1), 8).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "place", "more")


@query(f"WITH RECURSIVE {ACYCLIC}, p(dst, path) AS (SELECT dst, '24>' || dst FROM g WHERE src = 24 UNION ALL SELECT g.dst, path || '>' || g.dst FROM p JOIN g ON p.dst = g.src WHERE p.dst <> 1) SELECT path FROM p WHERE dst = 1")
def simple_paths_all(spark, sf):
    return graph.simple_paths(T.acyclic(spark, sf), 24, 1).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH RECURSIVE {ACYCLIC}, l(node, height) AS (SELECT n_nationkey, 0 FROM nation UNION SELECT g.src, height + 1 FROM l JOIN g ON l.node = g.dst) SELECT node, max(height) AS height FROM l GROUP BY node")
def layer_order(spark, sf):
    return graph.layers(T.acyclic(spark, sf), T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node")))


@query(f"WITH {ACYCLIC}, x AS (SELECT a.src AS s1, a.dst AS d1, b.src AS s2, b.dst AS d2 FROM g a JOIN g b ON a.src < b.src AND a.dst > b.dst) SELECT count(*) AS crossings FROM x")
def crossing_count(spark, sf):
    g = T.acyclic(spark, sf)
    return g.alias("a").join(g.alias("b"), (F.col("a.src") < F.col("b.src")) & (F.col("a.dst") > F.col("b.dst"))).agg(F.count("*").alias("crossings"))


@query(f"WITH RECURSIVE {EDGES}, u AS (SELECT DISTINCT target AS file, src AS dependent, (src % 5) || ':' || name AS name FROM e WHERE src <> dst AND target % 3 = 0), l AS (SELECT DISTINCT a.file, a.dependent AS x, b.dependent AS y FROM u a JOIN u b ON a.file = b.file AND a.name = b.name), r(file, x, y) AS (SELECT file, x, y FROM l UNION SELECT r.file, r.x, l.y FROM r JOIN l ON r.file = l.file AND r.y = l.x), p AS (SELECT file, x AS dependent, min(y) AS part FROM r GROUP BY file, x) SELECT * FROM p WHERE file IN (SELECT file FROM p GROUP BY file HAVING count(DISTINCT part) > 1)")
def split_groups(spark, sf):
    e = T.edges(spark, sf).where("src <> dst and target % 3 = 0").select(F.col("target").alias("file"), F.col("src").alias("dependent"), F.expr("concat(src % 5, ':', name)").alias("name"))
    return graph.split_groups(e)


@query("SELECT coalesce(a.c_custkey, b.c_custkey) AS key, CASE WHEN b.c_custkey IS NULL THEN 'added' WHEN a.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change, b.v AS old, a.v AS new FROM (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 7 <> 0) b FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 11 <> 0) a ON a.c_custkey = b.c_custkey WHERE a.v IS DISTINCT FROM b.v")
def map_diff(spark, sf):
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return diff.map_diff(c.where("key % 7 <> 0"), c.where("key % 11 <> 0").withColumn("value", F.when(F.expr("key % 5 = 0"), "MOVED").otherwise(F.col("value"))))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN 'resolved' WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'old' ELSE 'fresh' END AS status FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def pending_diff(spark, sf):
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return diff.split_keys(c.where("key % 2 = 0"), c.where("key % 3 = 0"))


MERGE = "b AS (SELECT c_custkey AS key, c_mktsegment AS v FROM customer WHERE c_custkey % 5 <> 0), o AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN 'OURS' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 7 <> 0), t AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 6 = 0 THEN 'THEIRS' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 11 <> 0)"


@query(f"WITH {MERGE}, j AS (SELECT c_custkey AS key, b.v AS b, o.v AS o, t.v AS t FROM customer LEFT JOIN b ON b.key = c_custkey LEFT JOIN o ON o.key = c_custkey LEFT JOIN t ON t.key = c_custkey), x AS (SELECT key, b IS DISTINCT FROM t AND o IS DISTINCT FROM t AND b IS DISTINCT FROM o AS conflict, CASE WHEN b IS NOT DISTINCT FROM o AND b IS DISTINCT FROM t THEN t ELSE o END AS value FROM j) SELECT key, value, conflict FROM x WHERE value IS NOT NULL OR conflict")
def three_way_merge(spark, sf):
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    side = lambda gone, mark, k: c.where(f"key % {gone} <> 0").withColumn("value", F.when(F.expr(f"key % {k} = 0"), mark).otherwise(F.col("value")))
    return diff.three_way_merge(c.where("key % 5 <> 0"), side(7, "OURS", 4), side(11, "THEIRS", 6))


ITEMS = "i AS (SELECT DISTINCT 'bucket' AS kind, 0 AS kind_rank, n_name AS label FROM nation UNION SELECT 'export', 1, p_brand FROM part UNION SELECT 'file', 2, replace(p_name, ' ', '/') FROM part)"


@query(f"WITH {ITEMS}, s AS (SELECT *, CASE WHEN NOT contains(lower(label), 'r') THEN -1 WHEN lower(label) = 'r' THEN CASE WHEN label = 'r' THEN 0 ELSE 0.5 END WHEN starts_with(lower(label), 'r') OR kind = 'file' AND starts_with(string_split(lower(label), '/')[-1], 'r') THEN 1 WHEN regexp_matches(lower(label), '[/_.-]r') THEN 2 ELSE 3 END::DOUBLE AS score FROM i) SELECT kind, label, score FROM s WHERE score >= 0 ORDER BY score, kind_rank, length(label), label LIMIT 20")
def ranked_search_top20(spark, sf):
    n, p = T.table(spark, sf, "nation"), T.table(spark, sf, "part")
    items = n.select(F.lit("bucket").alias("kind"), F.col("n_name").alias("label")).unionByName(p.select(F.lit("export").alias("kind"), F.col("p_brand").alias("label"))).unionByName(p.select(F.lit("file").alias("kind"), F.replace("p_name", F.lit(" "), F.lit("/")).alias("label")))
    return stats.search(items.distinct(), "r", 20)


@query("SELECT n_name, min((levenshtein(n_name, w), w))[2] AS suggestion FROM nation, (VALUES ('NATION_1'), ('NATIO_12'), ('XATION_3'), ('FRANCE')) t(w) WHERE levenshtein(n_name, w) <= 2 GROUP BY n_name")
def suggestions(spark, sf):
    words = ("NATION_1", "NATIO_12", "XATION_3", "FRANCE")
    n = T.table(spark, sf, "nation").select("n_name", F.explode(F.array(*map(F.lit, words))).alias("w")).withColumn("d", F.levenshtein("n_name", "w"))
    return n.where("d <= 2").groupBy("n_name").agg(F.min(F.struct("d", "w"))["w"].alias("suggestion"))


@query("WITH t AS (SELECT event_id AS \"at\", CASE event_id % 5 WHEN 0 THEN 'Uses ' || event_type WHEN 1 THEN 'It depends on the view.' WHEN 2 THEN event_type || ' rows' WHEN 3 THEN 'keeps the rows of each ' || event_type ELSE '' END AS text FROM events), w AS (SELECT \"at\", regexp_extract_all(lower(text), '[\\p{L}\\p{N}@:/._-]+') AS words FROM t), n AS (SELECT \"at\", len(words) AS n, len(list_filter(words, lambda x: NOT list_contains(['a','an','and','the','it','on','to','for','uses','use','needs','need','calls','call','imports','import','depends','depend'], x) AND NOT list_contains(['click','view'], regexp_replace(x, '[.:]+$', '')))) AS rest FROM w) SELECT \"at\", CASE WHEN rest = 0 THEN 'generic' ELSE 'short' END AS why FROM n WHERE rest = 0 OR n < 3")
def reason_advice(spark, sf):
    text = F.expr("CASE event_id % 5 WHEN 0 THEN concat('Uses ', event_type) WHEN 1 THEN 'It depends on the view.' WHEN 2 THEN concat(event_type, ' rows') WHEN 3 THEN concat('keeps the rows of each ', event_type) ELSE '' END")
    return stats.reason_advice(T.table(spark, sf, "events").select(F.col("event_id").alias("at"), text.alias("text")), ("click", "view"))


OVER = "e2 AS (SELECT src, dst, file, line FROM e WHERE file % 10 <> 0 UNION ALL SELECT src, CASE WHEN file % 20 = 0 THEN src ELSE (dst + 1) % 25 END, file, line FROM e WHERE file % 10 = 0 AND file % 30 <> 0)"


def _edited(spark, sf):
    e = T.edges(spark, sf).select("src", "dst", "file", "line")
    keyed = e.withColumn("id", F.concat_ws(":", "file", "line"))
    edits = keyed.where("file % 10 = 0").withColumn("deleted", F.expr("file % 30 = 0")).withColumn("dst", F.expr("case when file % 20 = 0 then src else (dst + 1) % 25 end"))
    return diff.overlay(keyed, edits, "id")


@query(f"WITH {EDGES}, {DECLARED}, {OVER} SELECT src, dst, count(*) AS imports, min((file, line))[1] AS first_file, min((file, line))[2] AS first_line FROM e2 WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM d) GROUP BY src, dst")
def overlay_edit(spark, sf):
    return relations.undeclared(_edited(spark, sf), T.declared(spark, sf))


@query(f"WITH {EDGES}, {DECLARED}, {OVER} SELECT DISTINCT src, dst FROM e WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM d) AND (src, dst) IN (SELECT (src, dst) FROM e2)")
def recheck_semi(spark, sf):
    before = relations.undeclared(T.edges(spark, sf), T.declared(spark, sf)).select("src", "dst")
    return diff.still_there(before, relations.undeclared(_edited(spark, sf), T.declared(spark, sf)), ["src", "dst"])


@query(f"WITH {EDGES}, {DECLARED}, {OVER}, x AS (SELECT DISTINCT src || '>' || dst AS key FROM e WHERE src <> dst), y AS (SELECT DISTINCT src || '>' || dst AS key FROM e2 WHERE src <> dst) SELECT coalesce(x.key, y.key) AS key, CASE WHEN x.key IS NULL THEN 'fresh' WHEN y.key IS NULL THEN 'resolved' ELSE 'old' END AS status FROM x FULL JOIN y ON x.key = y.key")
def snapshot_diff(spark, sf):
    key = lambda e: e.where("src <> dst").select(F.concat_ws(">", "src", "dst").alias("key"))
    return diff.split_keys(key(T.edges(spark, sf)), key(_edited(spark, sf)))


@query(f"WITH {EDGES}, {DECLARED}, v AS (SELECT DISTINCT 'undeclared' AS rule, src, dst FROM e WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM d)), g AS (SELECT rule, src AS n FROM v UNION ALL SELECT rule, dst FROM v) SELECT rule, n_name AS grp, count(*) AS n FROM g JOIN nation ON n = n_nationkey GROUP BY ALL")
def summary_by_group(spark, sf):
    names = T.table(spark, sf, "nation").select("n_nationkey", "n_name")
    v = relations.undeclared(T.edges(spark, sf), T.declared(spark, sf)).join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
    return stats.per_group(v.select(F.lit("undeclared").alias("rule"), F.array("a", "b").alias("groups")))


@query("SELECT event_type AS scenario, count(*) AS runs, round(median(value), 1) AS median, round(quantile_disc(value, 0.95), 1) AS p95, round(min(value), 1) AS least, round(max(value), 1) AS most FROM events GROUP BY event_type")
def bench_summary(spark, sf):
    return stats.bench_summary(T.table(spark, sf, "events").select(F.col("event_type").alias("scenario"), F.col("value").alias("ms")))


@query("SELECT CASE WHEN bool_or(event_type = 'purchase' AND value < 0) THEN 3 WHEN count(*) > 0 THEN 1 ELSE 0 END AS code FROM events")
def exit_code(spark, sf):
    kind = F.when(F.expr("event_type = 'purchase' and value < 0"), "environment").otherwise("violation")
    return stats.exit_code(T.table(spark, sf, "events").select(kind.alias("kind")))


@query(f"WITH {FILES} SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, string_split(path, '/')[-1] AS base, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(path), '[^a-z0-9-]+', '-', 'g'), '^[^a-z]+', ''), '-+$', ''), ''), 'bucket') AS slug, CASE WHEN length(path) <= 20 THEN path ELSE left(path, 9) || '...' || right(path, 8) END AS short, len(string_split(path, '/')) - 1 AS depth FROM f")
def path_functions(spark, sf):
    p = F.col("path")
    return T.page_files(spark, sf).select("path", P.dirname(p).alias("folder"), P.basename(p).alias("base"), P.slug(p).alias("slug"), P.truncate_middle(p, 20).alias("short"), F.size(P.ancestors(p)).cast("long").alias("depth"))


@query("WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'fs/promises' WHEN 1 THEN '@s' || p_size || '/x/y' WHEN 2 THEN 'node:test/' || p_size WHEN 3 THEN 'pkg' || p_size || '/deep/er' ELSE 'plain' || p_size END AS spec FROM part), b AS (SELECT *, regexp_replace(spec, '^node:', '') AS bare FROM s), k AS (SELECT *, CASE WHEN bare LIKE '@%' THEN string_split(bare, '/')[1] || '/' || string_split(bare, '/')[2] ELSE string_split(bare, '/')[1] END AS nm FROM b) SELECT p_partkey, CASE WHEN spec LIKE 'node:%' OR nm = 'fs' THEN 'node:' || nm ELSE nm END AS package FROM k")
def package_keys(spark, sf):
    m, size = F.expr("p_partkey % 5"), F.col("p_size").cast("string")
    spec = F.when(m == 0, "fs/promises").when(m == 1, F.concat(F.lit("@s"), size, F.lit("/x/y"))).when(m == 2, F.concat(F.lit("node:test/"), size)).when(m == 3, F.concat(F.lit("pkg"), size, F.lit("/deep/er"))).otherwise(F.concat(F.lit("plain"), size))
    return T.table(spark, sf, "part").select("p_partkey", P.package_key(spec).alias("package"))


@query(f"WITH {EDGES}, {DECLARED}, c AS (SELECT src, dst, count(*) AS n FROM e WHERE src <> dst GROUP BY ALL), s AS (SELECT coalesce(d.src, c.src) AS src, coalesce(d.dst, c.dst) AS dst, CASE WHEN n IS NULL THEN 'unused' WHEN d.src IS NULL THEN 'undeclared' ELSE 'used' END AS state FROM d FULL JOIN c ON d.src = c.src AND d.dst = c.dst), i AS (SELECT n_nationkey, 'b' || (row_number() OVER (ORDER BY n_name) - 1) AS id FROM nation) SELECT x.id || CASE state WHEN 'unused' THEN ' -.-> ' WHEN 'undeclared' THEN ' ==> ' ELSE ' --> ' END || y.id AS text FROM s JOIN i x ON x.n_nationkey = src JOIN i y ON y.n_nationkey = dst")
def mermaid_export(spark, sf):
    names = T.table(spark, sf, "nation").select("n_nationkey", "n_name")
    e = edge_state(spark, sf).join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "state")
    return reports.mermaid_edges(names.select(F.col("n_name").alias("name")), e)


@query("SELECT '::error file=' || replace(replace(replace(url, '%', '%25'), ':', '%3A'), ',', '%2C') || ',line=' || page_id || '::page ' || page_id || ' of 100%25' AS text FROM pages")
def annotations(spark, sf):
    p = T.table(spark, sf, "pages")
    return reports.annotations(p.select(F.col("url").alias("file"), F.col("page_id").alias("line"), F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(" of 100%")).alias("text")))


@query(f"WITH {EDGES}, {DECLARED}, u AS (SELECT src, dst, min((file, line)) AS m FROM e WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM d WHERE d.src = e.src AND d.dst = e.dst) GROUP BY ALL) SELECT json_object('ruleId', 'undeclared', 'message', json_object('text', src || ' to ' || dst), 'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', m[1]::VARCHAR), 'region', json_object('startLine', m[2])))))::VARCHAR AS text FROM u")
def sarif_results(spark, sf):
    u = relations.undeclared(T.edges(spark, sf), T.declared(spark, sf))
    return reports.sarif_results(u.select(F.lit("undeclared").alias("rule"), F.col("first_file").cast("string").alias("file"), F.col("first_line").alias("line"), F.concat_ws(" to ", "src", "dst").alias("text")))


@query(f"WITH RECURSIVE {SPARSE}, r(a, b) AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g UNION SELECT r.a, h.b FROM r JOIN (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g) h ON r.b = h.a) SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a")
def linked_groups(spark, sf):
    return components.connected_components(T.sparse(spark, sf), "src", "dst")


import concord.registry_projects  # noqa: E402,F401  adds its queries
import concord.registry_resolve  # noqa: E402,F401  adds its queries
import concord.registry_rules  # noqa: E402,F401  adds its queries
import concord.registry_streams  # noqa: E402,F401  adds its queries
import concord.registry_text  # noqa: E402,F401  adds its queries


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
