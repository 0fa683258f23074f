"""Queries of the check's rules, findings and reports, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import paths as P
from concord.operators import findings as R
from concord.operators import relations
from concord.plans.shared import cut, scratch
from concord.registry import ACYCLIC, DECLARED, EDGES, FILES, GLOB_SQL, glob_empty, ownership_last_match, query
from concord.sources import tables as T

IMPORTS = f"""{EDGES}, i AS (SELECT CASE WHEN file % 9 <> 0 THEN src END AS src, file, line % 3 AS line, line AS stmt, './m' || target AS specifier,
CASE target % 50 WHEN 1 THEN 'dynamic' WHEN 2 THEN 'outside' WHEN 3 THEN 'relative' WHEN 4 THEN 'paths' WHEN 5 THEN 'workspace' WHEN 6 THEN 'other' ELSE 'file' END AS kind, target, dst,
CASE WHEN target % 20 = 0 THEN 'ignored' WHEN target % 20 = 17 THEN 'unowned' ELSE 'owned' END AS state,
CASE (file + line) % 11 WHEN 0 THEN 'import' WHEN 1 THEN 'export' WHEN 2 THEN 'dynamic' WHEN 3 THEN 'require' END AS namespace, name FROM e),
c AS (SELECT * FROM (SELECT *, CASE WHEN kind = 'dynamic' THEN 'dynamic' WHEN kind = 'outside' THEN 'package' WHEN kind IN ('relative', 'paths', 'workspace') THEN 'unresolved' WHEN kind = 'file' AND state = 'ignored' THEN 'ignored' WHEN kind = 'file' AND state = 'owned' AND src <> dst THEN 'cross' END AS class FROM i WHERE src IS NOT NULL) WHERE class IS NOT NULL)"""


def _first(keys: str, cols: str, where: str) -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY line, stmt) AS k FROM c WHERE {where}) WHERE k = 1"


DYNAMIC = _first("file, line", "file, line", "class = 'dynamic'")
UNRESOLVED = _first("file, specifier", "file, line, src, specifier, kind", "class = 'unresolved'")
IGNORED = _first("file, target", "file, line, target", "class = 'ignored'")
NAMESPACE = _first("file, line, specifier", "file, line, src, dst, namespace AS form, specifier", "class = 'cross' AND namespace IS NOT NULL")


def _edges(spark, sf):
    return R.dispatch(T.imports(spark, sf))


@query(f"WITH {IMPORTS} SELECT class, count(*) AS n FROM c GROUP BY class")
def edge_dispatch(spark, sf):
    return _edges(spark, sf).groupBy("class").agg(F.count("*").alias("n"))


@query(f"WITH {IMPORTS} SELECT file, count(*) AS imports FROM i WHERE src IS NOT NULL GROUP BY file")
def owned_source_filter(spark, sf):
    return R.owned_sources(T.imports(spark, sf)).groupBy("file").agg(F.count("*").alias("imports"))


@query(f"WITH {IMPORTS} {DYNAMIC}")
def import_dynamic(spark, sf):
    return R.dynamic(_edges(spark, sf))


@query(f"WITH {IMPORTS} {UNRESOLVED}")
def import_unresolved(spark, sf):
    return R.unresolved(_edges(spark, sf))


@query(f"WITH {IMPORTS} {IGNORED}")
def import_ignored(spark, sf):
    return R.ignored(_edges(spark, sf))


@query(f"WITH {IMPORTS} {NAMESPACE}")
def import_namespace(spark, sf):
    return R.namespace(_edges(spark, sf))


@query(f"WITH {IMPORTS} SELECT kind, count(*) AS n FROM ({UNRESOLVED}) GROUP BY kind")
def unresolved_counts(spark, sf):
    return R.unresolved(_edges(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {IMPORTS} SELECT n_nationkey AS src, n_nationkey IN (SELECT src FROM c WHERE class = 'unresolved') AS unresolved_from, (SELECT coalesce(bool_or(class = 'unresolved' AND kind <> 'relative'), FALSE) FROM c) AS hold_all FROM nation")
def guard_flags(spark, sf):
    return R.guards(_edges(spark, sf), T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("src")))


@query(f"WITH {IMPORTS} SELECT target, name, src, count(*) AS imports FROM c WHERE class = 'cross' AND namespace IS NULL AND target % 3 = 0 GROUP BY ALL")
def export_consumers(spark, sf):
    public = T.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("target"))
    return R.consumers(_edges(spark, sf), public)


@query(f"WITH {IMPORTS} SELECT target, src, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM c WHERE class = 'cross' AND namespace IS NULL GROUP BY target, src")
def dependents_with_names(spark, sf):
    return _edges(spark, sf).where("class = 'cross' and namespace is null").groupBy("target", "src").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


LISTED = "l AS (SELECT n_nationkey AS owner, s_suppkey AS file FROM nation JOIN (SELECT s_suppkey FROM supplier UNION SELECT -1) ON (s_suppkey + n_nationkey) % 7 = 0), f AS (SELECT s_suppkey AS file, CASE WHEN s_suppkey % 20 = 0 THEN 'ignored' WHEN s_suppkey % 20 = 17 THEN 'unowned' ELSE 'owned' END AS state, s_nationkey AS grp FROM supplier)"
MISSING = "SELECT owner, l.file, CASE WHEN state IS NULL THEN 'not-found' WHEN state <> 'owned' THEN state ELSE 'other-group' END AS why FROM l LEFT JOIN f ON l.file = f.file WHERE state IS NULL OR state <> 'owned' OR grp <> owner"


@query(f"WITH {LISTED} {MISSING}")
def public_missing(spark, sf):
    s = T.table(spark, sf, "supplier")
    files = s.selectExpr("s_suppkey AS file", "CASE WHEN s_suppkey % 20 = 0 THEN 'ignored' WHEN s_suppkey % 20 = 17 THEN 'unowned' ELSE 'owned' END AS state", "s_nationkey AS group")
    every = s.select(F.col("s_suppkey").alias("file")).unionByName(s.select(F.lit(-1).cast(s.schema["s_suppkey"].dataType).alias("file")).distinct())
    listed = every.select("file", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("owner")).where("(file + owner) % 7 = 0")
    return R.public_missing(listed, files)


def _key(rule: str, *identity: str) -> str:
    return f"""'{rule}' AS rule, {{file}} AS file, {{line}} AS line, '["{rule}","' || {' || \'","\' || '.join(identity)} || '"]' AS key"""


def _found(rule: str, rows: str, *identity: str, file: str = "NULL", line: str = "NULL") -> str:
    return f"SELECT {_key(rule, *identity).format(file=f'CAST({file} AS VARCHAR)', line=line)} FROM ({rows})"


#: Groups and the packages they declare; names that public files export.
PACKAGES = "SELECT DISTINCT p_size % 25 AS src, p_brand AS name FROM part"
EXPORTS = "SELECT s_suppkey AS target, 'Brand#' || (1 + s_suppkey % 5) || (1 + k) AS name FROM supplier, range(5) t(k) WHERE s_suppkey % 3 = 0"
_UNHELD = "src NOT IN (SELECT src FROM c WHERE class = 'unresolved')"
VIOLATIONS = "v AS (" + " UNION ".join([
    _found("import-dynamic", DYNAMIC, "file", "line", file="file", line="line"),
    _found("import-unresolved", UNRESOLVED, "file", "specifier", file="file", line="line"),
    _found("import-ignored", IGNORED, "file", "target", file="file", line="line"),
    _found("import-namespace", NAMESPACE, "file", "line", "specifier", file="file", line="line"),
    _found("import-private", _first("file, target", "file, line, target", "class = 'cross' AND target % 3 <> 0 AND EXISTS (SELECT 1 FROM d WHERE d.src = c.src AND d.dst = c.dst)"), "file", "target", file="file", line="line"),
    _found("dependency-undeclared", "SELECT src, dst, min((file, line))[1] AS file, min((file, line))[2] AS line FROM c WHERE class = 'cross' AND NOT EXISTS (SELECT 1 FROM d WHERE d.src = c.src AND d.dst = c.dst) GROUP BY src, dst", "src", "dst", file="file", line="line"),
    _found("dependency-unused", f"SELECT src, dst FROM d WHERE {_UNHELD} EXCEPT SELECT src, dst FROM c WHERE class = 'cross'", "src", "dst"),
    _found("public-missing", f"WITH {LISTED} {MISSING}", "owner", "file"),
    _found("export-unused", f"{EXPORTS} EXCEPT SELECT target, name FROM c WHERE class = 'cross' AND namespace IS NULL", "target", "name", file="target"),
    _found("package-undeclared", f"SELECT src, name FROM c WHERE class = 'package' EXCEPT {PACKAGES}", "src", "name"),
    _found("package-unused", f"SELECT src, name FROM ({PACKAGES}) WHERE {_UNHELD} EXCEPT SELECT src, name FROM c WHERE class = 'package'", "src", "name"),
    _found("file-unowned", f"WITH {FILES}, {GLOB_SQL} SELECT path FROM o WHERE state = 'unowned'", "path", file="path"),
    _found("file-overlap", f"WITH {FILES}, {GLOB_SQL} SELECT path, owners FROM o WHERE state = 'overlap'", "path", "owners", file="path"),
    _found("glob-empty", f"WITH {FILES}, {GLOB_SQL}, ids AS (SELECT unnest(range(10))::INT AS glob_id) SELECT glob_id FROM ids WHERE glob_id NOT IN (SELECT glob_id FROM k WHERE counts)", "glob_id"),
]) + ")"


def _findings(spark, sf):
    """The findings of fourteen rules. Imports are joined and dispatched once, and written; each rule reads what it needs of them."""
    e = cut(_edges(spark, sf), "findings-edges")
    declared = T.declared(spark, sf)
    cross, package = e.where("class = 'cross'"), e.where("class = 'package'").select("src", "name").distinct()
    held = e.where("class = 'unresolved'").select("src").distinct()
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("target"))
    public = s.where("target % 3 = 0")
    exports = public.select("target", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.concat(F.lit("Brand#"), (1 + F.col("target") % 5).cast("string"), k.cast("string")))).alias("name"))
    packages = T.table(spark, sf, "part").selectExpr("p_size % 25 AS src", "p_brand AS name").distinct()
    owned = cut(ownership_last_match(spark, sf), "findings-owners")
    none, file, line = F.lit(None), F.col("file"), F.col("line")
    return [
        R.finding(R.dynamic(e), "import-dynamic", file, line, "file", "line"),
        R.finding(R.unresolved(e), "import-unresolved", file, line, "file", "specifier"),
        R.finding(R.ignored(e), "import-ignored", file, line, "file", "target"),
        R.finding(R.namespace(e), "import-namespace", file, line, "file", "line", "specifier"),
        R.finding(R.private(e, declared, public), "import-private", file, line, "file", "target"),
        R.finding(relations.undeclared(cross, declared), "dependency-undeclared", F.col("first_file"), F.col("first_line"), "src", "dst"),
        R.finding(relations.unused(cross, declared, held), "dependency-unused", none, none, "src", "dst"),
        R.finding(public_missing(spark, sf), "public-missing", none, none, "owner", "file"),
        R.finding(exports.join(cross.where("namespace is null").select("target", "name").distinct(), ["target", "name"], "left_anti"), "export-unused", F.col("target"), none, "target", "name"),
        R.finding(package.join(packages, ["src", "name"], "left_anti"), "package-undeclared", none, none, "src", "name"),
        R.finding(packages.join(held, "src", "left_anti").join(package, ["src", "name"], "left_anti"), "package-unused", none, none, "src", "name"),
        R.finding(owned.where("state = 'unowned'"), "file-unowned", F.col("path"), none, "path"),
        R.finding(owned.where("state = 'overlap'"), "file-overlap", F.col("path"), none, "path", "owners"),
        R.finding(glob_empty(spark, sf), "glob-empty", none, none, "glob_id"),
    ]


@query(f"WITH {IMPORTS}, {DECLARED}, {VIOLATIONS} SELECT *, row_number() OVER (ORDER BY coalesce(file, ''), coalesce(line, 0), rule, key) AS place FROM v")
def violations(spark, sf):
    with scratch() as made:
        return made.keep(cut(R.ordered(_findings(spark, sf)), "findings"))


@query(f"WITH {IMPORTS}, {DECLARED}, {VIOLATIONS} SELECT rule, count(*) AS n, list_position({list(R.RULES)}, rule)::INT AS place FROM v GROUP BY rule")
def rule_counts(spark, sf):
    with scratch() as made:
        return made.keep(cut(R.per_rule(reduce(DataFrame.unionByName, _findings(spark, sf)).distinct()), "rule-counts"))


@query(f"WITH {IMPORTS}, x AS (SELECT 'i' AS rule, CAST(file AS VARCHAR) AS key FROM ({IGNORED}) WHERE file % 5 <> 0), y AS (SELECT 'i' AS rule, CAST(file AS VARCHAR) AS key FROM ({IGNORED}) WHERE file % 7 <> 0) SELECT 'i' AS rule, (SELECT count(*) FROM x) AS was, (SELECT count(*) FROM y) AS now, (SELECT count(*) FROM y WHERE key NOT IN (SELECT key FROM x)) AS new_keys")
def worse_findings(spark, sf):
    found = R.ignored(_edges(spark, sf)).select(F.lit("i").alias("rule"), F.col("file").cast("string").alias("key"))
    return R.worse(found.where("cast(key as long) % 5 <> 0"), found.where("cast(key as long) % 7 <> 0"))


@query("WITH u AS (SELECT a.n_name AS g, b.n_name AS dep FROM nation a JOIN nation b ON (a.n_nationkey + b.n_nationkey) % 6 = 0 AND a.n_nationkey <> b.n_nationkey), w AS (SELECT CASE WHEN n_nationkey % 4 = 3 THEN 'NEW_' || n_nationkey ELSE n_name END AS name, n_nationkey AS pos FROM nation) SELECT dep AS \"from\", (SELECT arg_min(name, pos) FROM w WHERE name NOT IN (SELECT n_name FROM nation)) AS \"to\", string_agg(DISTINCT g, ',' ORDER BY g) AS referenced_by FROM u WHERE dep NOT IN (SELECT name FROM w) GROUP BY dep")
def group_renames(spark, sf):
    n = T.table(spark, sf, "nation")
    before = n.selectExpr("n_name AS name", "n_nationkey AS pos")
    after = n.selectExpr("CASE WHEN n_nationkey % 4 = 3 THEN concat('NEW_', n_nationkey) ELSE n_name END AS name", "n_nationkey AS pos")
    other = T.pairs(spark, sf, "(src + dst) % 6 = 0").join(n.selectExpr("n_nationkey AS src", "n_name AS group"), "src").join(n.selectExpr("n_nationkey AS dst", "n_name AS dependency"), "dst")
    return R.renames(other.select("group", "dependency"), before, after)


@query("WITH a AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS k FROM orders WHERE o_orderstatus <> 'P') SELECT coalesce(a.id, b.id) AS id, bool_and(a.id IS NOT NULL AND b.id IS NOT NULL) AS equal, bool_and(b.id IS NOT NULL) AS subset FROM a FULL JOIN b ON a.id = b.id AND a.k = b.k GROUP BY coalesce(a.id, b.id)")
def key_sets(spark, sf):
    o = T.table(spark, sf, "orders")
    keys = lambda where: o.where(where).selectExpr("o_custkey AS id", "o_orderpriority AS key")
    return R.sets_compared(keys("o_orderstatus = 'O'"), keys("o_orderstatus <> 'P'"))


@query("SELECT coalesce(a.p_partkey, b.p_partkey) AS target, coalesce(a.p_brand, b.p_brand) AS name, CASE WHEN b.p_brand IS NULL THEN 'removed' ELSE 'added' END AS change FROM (SELECT p_partkey, p_brand FROM part WHERE p_size % 3 <> 0) a FULL JOIN (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'renamed' ELSE p_brand END AS p_brand FROM part) b ON a.p_partkey = b.p_partkey AND a.p_brand = b.p_brand WHERE a.p_brand IS NULL OR b.p_brand IS NULL")
def export_diff(spark, sf):
    p = T.table(spark, sf, "part")
    was = p.where("p_size % 3 <> 0").selectExpr("p_partkey AS target", "p_brand AS name")
    now = p.selectExpr("p_partkey AS target", "CASE WHEN p_size % 5 = 0 THEN 'renamed' ELSE p_brand END AS name")
    return was.join(now, ["target", "name"], "left_anti").withColumn("change", F.lit("removed")).unionByName(now.join(was, ["target", "name"], "left_anti").withColumn("change", F.lit("added")))


@query(f"WITH RECURSIVE {ACYCLIC}, a AS (SELECT dst AS node FROM g WHERE src = 12), b AS (SELECT src AS node FROM g WHERE dst = 12) SELECT DISTINCT node FROM (SELECT 12 AS node UNION ALL SELECT node FROM a UNION ALL SELECT dst FROM g WHERE src IN (SELECT node FROM a) UNION ALL SELECT node FROM b UNION ALL SELECT src FROM g WHERE dst IN (SELECT node FROM b))")
def focus_neighbourhood(spark, sf):
    return R.neighbourhood(T.acyclic(spark, sf), spark.createDataFrame([(12,)], "node int"), 2)


@query(f"WITH {EDGES}, {DECLARED}, o AS (SELECT n_nationkey AS node, row_number() OVER (ORDER BY n_name) AS pos FROM nation), s AS (SELECT coalesce(d.src, c.src) AS src, coalesce(d.dst, c.dst) AS dst, CASE WHEN c.src IS NULL THEN 'unused' WHEN d.src IS NULL THEN 'undeclared' ELSE 'used' END AS state FROM d FULL JOIN (SELECT DISTINCT src, dst FROM e WHERE src <> dst) c ON d.src = c.src AND d.dst = c.dst) SELECT a.pos AS \"row\", b.pos AS col, state FROM s JOIN o a ON a.node = src JOIN o b ON b.node = dst")
def adjacency_matrix(spark, sf):
    from pyspark.sql import Window as W

    order = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.row_number().over(W.orderBy("n_name")).alias("pos"))  # one row a group
    return R.matrix(relations.edge_state(T.edges(spark, sf), T.declared(spark, sf)), order)


@query(f"WITH {FILES}, {GLOB_SQL} SELECT owners AS grp, count(*) AS files FROM o WHERE state = 'owned' GROUP BY owners")
def files_per_group(spark, sf):
    return ownership_last_match(spark, sf).where("state = 'owned'").groupBy(F.col("owner").alias("grp")).agg(F.count("*").alias("files"))


@query(f"WITH {FILES}, {GLOB_SQL} SELECT path, owners FROM o WHERE state = 'overlap'")
def file_overlap(spark, sf):
    return ownership_last_match(spark, sf).where("state = 'overlap'").select("path", "owners")


@query(f"WITH {FILES}, {GLOB_SQL} SELECT path, state FROM o WHERE state = 'owned' AND contains(lower(path), '1')")
def file_filter(spark, sf):
    return ownership_last_match(spark, sf).where((F.col("state") == "owned") & F.lower("path").contains("1")).select("path", "state")


TOOLING = r"(^|/)(__tests__|__mocks__|__fixtures__|tests?|specs?|fixtures?|examples?|e2e|scripts?|bench(marks?)?)/|(^|/)test[-_][^/]*$|\.(test|spec|bench|stories)\.[^/]+$"  # a fixed value


@query("WITH p AS (SELECT p_partkey, replace(p_name, ' ', '/') || CASE p_partkey % 5 WHEN 0 THEN '/tests/a.ts' WHEN 1 THEN '.spec.ts' WHEN 2 THEN '/test-x.ts' WHEN 3 THEN '/latest/a.ts' ELSE '/attest.ts' END AS path FROM part) SELECT p_partkey, path FROM p WHERE p_partkey % 5 < 3")
def tooling_paths(spark, sf):
    path = F.expr("concat(replace(p_name, ' ', '/'), CASE p_partkey % 5 WHEN 0 THEN '/tests/a.ts' WHEN 1 THEN '.spec.ts' WHEN 2 THEN '/test-x.ts' WHEN 3 THEN '/latest/a.ts' ELSE '/attest.ts' END)")
    return T.table(spark, sf, "part").select("p_partkey", path.alias("path")).where(F.col("path").rlike(TOOLING))


@query("WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '2.' || p_size WHEN 1 THEN (p_size % 4) || '.0' WHEN 2 THEN 'v' || p_size ELSE '2.0.' || p_size END AS v FROM part) SELECT p_partkey, CASE WHEN NOT regexp_full_match(v, '[0-9]+\\.[0-9]+') THEN 'invalid' WHEN CAST(split_part(v, '.', 1) AS INT) < 2 THEN 'invalid' WHEN CAST(split_part(v, '.', 1) AS INT) > 2 OR CAST(split_part(v, '.', 2) AS INT) > 7 THEN 'newer' ELSE 'supported' END AS status FROM v")
def version_status(spark, sf):
    v = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('2.', p_size) WHEN 1 THEN concat(p_size % 4, '.0') WHEN 2 THEN concat('v', p_size) ELSE concat('2.0.', p_size) END")
    return T.table(spark, sf, "part").select("p_partkey", P.version_status(v, 2, 7).alias("status"))


@query("WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'node:fs' WHEN 1 THEN '@s' || p_size || '/x' WHEN 2 THEN '@s/x/y' || p_size ELSE 'pkg/deep' END AS s FROM part) SELECT p_partkey, CASE WHEN s LIKE '@%' THEN split_part(s, '/', 1) || '/' || split_part(s, '/', 2) ELSE split_part(s, '/', 1) END AS package, p_partkey % 4 >= 2 AS sub FROM s")
def package_names(spark, sf):
    s = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'node:fs' WHEN 1 THEN concat('@s', p_size, '/x') WHEN 2 THEN concat('@s/x/y', p_size) ELSE 'pkg/deep' END")
    return T.table(spark, sf, "part").select("p_partkey", P.package_name(s).alias("package"), P.is_subpath(s).alias("sub"))


@query("WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_partkey % 3 = 0 AS ind FROM part), n AS (SELECT p_partkey, ind, CASE WHEN ind THEN w[1] ELSE w[1] || list_reduce(list_prepend('', list_transform(w[2:], lambda x: upper(x[1]) || x[2:])), lambda a, b: a || b) END AS n FROM w) SELECT p_partkey, n AS name FROM n")
def default_export_names(spark, sf):
    p = F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat('src/', substring_index(p_name, ' ', 1), '/index.d.ts') ELSE concat('src/', replace(p_name, ' ', '-'), '.tsx') END")
    return T.table(spark, sf, "part").select("p_partkey", P.default_export_name(p).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN './' || p_partkey WHEN 1 THEN '../g' || (p_size % 7) || '/' || p_partkey ELSE './sub/' || p_partkey END AS specifier FROM part")
def reexport_specifiers(spark, sf):
    public = F.expr("CASE p_partkey % 3 WHEN 1 THEN 'src/other/index.ts' ELSE concat('src/g', p_size % 7, '/index.ts') END")
    target = F.expr("concat('src/g', p_size % 7, CASE p_partkey % 3 WHEN 2 THEN '/sub/' ELSE '/' END, p_partkey, '.ts')")
    return T.table(spark, sf, "part").select("p_partkey", P.reexport_specifier(public, target).alias("specifier"))


@query(f"WITH {EDGES}, s AS (SELECT src, count(*) AS imports, count(DISTINCT target) AS targets FROM e WHERE src <> dst GROUP BY src) SELECT n_name, imports, targets, row_number() OVER (ORDER BY imports DESC, n_name) AS place FROM s JOIN nation ON n_nationkey = src")
def group_rows(spark, sf):
    from pyspark.sql import Window as W

    e = T.edges(spark, sf).where("src <> dst").groupBy("src").agg(F.count("*").alias("imports"), F.countDistinct("target").alias("targets"))
    rows = e.join(T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("src"), "n_name"), "src")
    return rows.select("n_name", "imports", "targets", F.row_number().over(W.orderBy(F.desc("imports"), "n_name")).cast("long").alias("place"))  # one row a group


@query(f"WITH {EDGES}, s AS (SELECT src, count(*) AS n FROM e WHERE src <> dst GROUP BY src) SELECT n_name AS focus FROM s JOIN nation ON n_nationkey = src ORDER BY n DESC, n_name LIMIT 1")
def focus_group(spark, sf):
    return group_rows(spark, sf).orderBy("place").limit(1).select(F.col("n_name").alias("focus"))


@query(f"WITH {EDGES}, t AS (SELECT DISTINCT src, dst, target FROM e WHERE src <> dst), r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY target) AS k, count(*) OVER (PARTITION BY src, dst) AS n FROM t) SELECT src, dst, string_agg(CAST(target AS VARCHAR), ', ' ORDER BY target) || CASE WHEN any_value(n) > 3 THEN ' and ' || (any_value(n) - 3) || ' more' ELSE '' END AS text FROM r WHERE k <= 3 GROUP BY src, dst")
def capped_lists(spark, sf):
    every = T.edges(spark, sf).where("src <> dst").groupBy("src", "dst").agg(F.array_sort(F.collect_set("target")).alias("t"))
    more = F.when(F.size("t") > 3, F.concat(F.lit(" and "), (F.size("t") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return every.select("src", "dst", F.concat(F.array_join(F.slice("t", 1, 3).cast("array<string>"), ", "), more).alias("text"))


@query("SELECT o_custkey AS project, o_orderkey AS key, 'new' AS version FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 'old' FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def covered_projects(spark, sf):
    o = T.table(spark, sf, "orders").selectExpr("o_custkey AS project", "o_orderkey AS key", "o_orderstatus")
    new = o.where("o_orderstatus = 'F'")
    old = o.where("o_orderstatus = 'O'").join(new.select("project").distinct(), "project", "left_anti")
    return new.select("project", "key", F.lit("new").alias("version")).unionByName(old.select("project", "key", F.lit("old").alias("version")))
