"""Queries of message texts, versions, diagrams, listings and seeded projects, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord import registry as G
from concord.functions import paths as P
from concord.functions import text as X
from concord.operators import diagrams, diff, relations, resolve, sources, stats
from concord.operators import findings as R
from concord.registry import DECLARED, EDGES, FILES, query
from concord.sources import scanner
from concord.sources import tables as T


@query("SELECT page_id, array_to_string(list_transform(string_split(s, ''), lambda c: CASE WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t' WHEN unicode(c) < 32 OR unicode(c) BETWEEN 127 AND 159 OR unicode(c) IN (8232, 8233) THEN printf('\\u%04x', unicode(c)) ELSE c END), '') AS text FROM (SELECT page_id, url || chr((1 + page_id % 31)::INT) || chr((127 + page_id % 33)::INT) || chr(8232) || 'x' AS s FROM pages)")
def one_line_texts(spark, sf):
    s = F.concat("url", F.char((1 + F.col("page_id") % 31)), F.char(127 + F.col("page_id") % 33), F.lit(" x"))
    return T.table(spark, sf, "pages").select("page_id", X.one_line(s).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'groups.g' || p_size || '.dependsOn[' || p_size || ']' WHEN 1 THEN 'groups[\"' || p_brand || '\"].public' WHEN 2 THEN '[\"9 \\\"' || p_size || '\\\"\"].a-b' ELSE 'ignore[' || p_size || ']' END AS at FROM part")
def config_paths(spark, sf):
    name = lambda c: F.struct(c.alias("name"), F.lit(None).cast("int").alias("k"))
    word = lambda s: name(F.lit(s))
    place = F.struct(F.lit(None).cast("string").alias("name"), F.col("p_size").cast("int").alias("k"))
    n, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    at = (
        F.when(n == 0, F.array(word("groups"), name(F.concat(F.lit("g"), size)), word("dependsOn"), place))
        .when(n == 1, F.array(word("groups"), name(F.col("p_brand")), word("public")))
        .when(n == 2, F.array(name(F.concat(F.lit('9 "'), size, F.lit('"'))), word("a-b")))
        .otherwise(F.array(word("ignore"), place))
    )
    return T.table(spark, sf, "part").select("p_partkey", X.config_path(at).alias("at"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type IN ('click', 'view') WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN event_type IN ('click', 'view') ELSE true END AS filler FROM events")
def filler_purposes(spark, sf):
    s = F.expr("CASE event_id % 6 WHEN 0 THEN concat('Does the ', event_type, ' job') WHEN 1 THEN 'Handles view stuff.' WHEN 2 THEN 'Keeps rows' WHEN 3 THEN '' WHEN 4 THEN concat(event_type, ': handles all of its misc things') ELSE 'The view: depends on click:' END")
    return T.table(spark, sf, "events").select("event_id", X.filler_only(s, ("click", "view", "stuff")).alias("filler"))


#: From the oldest to the newest, with those of one rank equal; written by hand from the rules of semver.
RANKED = (
    (0, "no version"), (0, "1.2"), (1, "0.9.10"), (2, "1.0.0-1"), (2, "1.0.0-01"), (3, "1.0.0-2"), (4, "1.0.0-10"), (5, "1.0.0-alpha"), (6, "1.0.0-alpha.1"), (7, "1.0.0-alpha.beta"),
    (8, "1.0.0-beta"), (9, "1.0.0-beta.2"), (10, "1.0.0-beta.11"), (11, "1.0.0-rc.1"), (12, "1.0.0"), (12, "1.0.0+build.5"), (13, "1.0.2"), (14, "1.0.10"), (15, "1.2.0"), (16, "1.10.0"), (17, "10.0.0"),
)


@query(f"WITH v(i, r) AS (VALUES {', '.join(f'({i}, {r})' for i, (r, _) in enumerate(RANKED))}) SELECT event_id, sign(a.r - b.r)::INT AS compared FROM events JOIN v a ON a.i = event_id % {len(RANKED)} JOIN v b ON b.i = (event_id // {len(RANKED)}) % {len(RANKED)}")
def version_order(spark, sf):
    names = F.array(*(F.lit(v) for _, v in RANKED))
    at = lambda e: F.element_at(names, F.expr(f"cast(({e}) % {len(RANKED)} as int) + 1"))
    return T.table(spark, sf, "events").select("event_id", X.compare_versions(at("event_id"), at(f"event_id div {len(RANKED)}")).alias("compared"))


@query("SELECT doc_id, sha1(text) AS hash, left(sha256(text), 16) AS stamp FROM documents")
def content_stamps(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("hash"), X.short_stamp(F.col("text")).alias("stamp"))


NAMED = "i AS (SELECT 'src/g' || l_linenumber || '/index.ts' AS public, 'lib/m' || l_suppkey % 50 || '.ts' AS target, CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'default' ELSE 'n' || l_partkey % 7 END AS name, l_orderkey % 3 = 0 AS type_only, l_suppkey % 4 = 1 AS is_type FROM lineitem)"


@query(f"WITH {NAMED}, s AS (SELECT public, target, CASE WHEN name IS NULL THEN 'name' WHEN name = 'default' THEN 'default as m' || target[6:-4] ELSE name END AS n, name IS NOT NULL AND (type_only OR is_type) AS t FROM i), k AS (SELECT public, target, n, bool_and(t) AS t FROM s GROUP BY ALL) SELECT public, target, t AS types, 'export ' || CASE WHEN t THEN 'type ' ELSE '' END || '{{ ' || string_agg(n, ', ' ORDER BY n) || ' }} from ''../../lib/' || target[5:-4] || '''' AS text FROM k GROUP BY public, target, t".replace("{{", "{").replace("}}", "}"))
def reexport_statements(spark, sf):
    i = T.table(spark, sf, "lineitem").selectExpr(
        "concat('src/g', l_linenumber, '/index.ts') AS public", "concat('lib/m', l_suppkey % 50, '.ts') AS target",
        "CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'default' ELSE concat('n', l_partkey % 7) END AS name", "l_orderkey % 3 = 0 AS type_only", "l_suppkey % 4 = 1 AS is_type",
    )
    return relations.reexports(i)


@query(f"WITH {EDGES}, {DECLARED}, c AS (SELECT src, dst, count(*) AS n FROM e WHERE src <> dst GROUP BY ALL), s AS (SELECT coalesce(d.src, c.src) AS src, coalesce(d.dst, c.dst) AS dst, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'unused' WHEN d.src IS NULL THEN 'undeclared' ELSE 'used' END AS state FROM d FULL JOIN c ON d.src = c.src AND d.dst = c.dst) SELECT src, dst, CASE state WHEN 'unused' THEN '0' ELSE n::VARCHAR END AS cell, 'g' || src || ' -> g' || dst || ': ' || CASE state WHEN 'unused' THEN 'declared, never imported' WHEN 'used' THEN n || ' import' || CASE n WHEN 1 THEN '' ELSE 's' END ELSE 'undeclared, ' || n || ' import' || CASE n WHEN 1 THEN '' ELSE 's' END END AS title FROM s")
def edge_titles(spark, sf):
    e, d = T.edges(spark, sf), T.declared(spark, sf).withColumn("said", F.lit(True))
    c = e.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    s = d.join(c, ["src", "dst"], "full").withColumn("state", F.when(F.col("n").isNull(), "unused").when(F.col("said").isNull(), "undeclared").otherwise("used")).fillna(0, ["n"])
    g = lambda x: F.concat(F.lit("g"), F.col(x).cast("string"))
    return s.select("src", "dst", X.cell_text(F.col("state"), F.col("n")).alias("cell"), X.cell_title(g("src"), g("dst"), F.col("state"), F.col("n")).alias("title"))


@query("SELECT s_suppkey, replace(replace(replace(replace('#' || s_name || '<' || s_nationkey || '> \"q\"\\ y', '#', '#35;'), '\"', '#quot;'), '<', '#lt;'), '>', '#gt;') AS mermaid, '\"#' || s_name || '<' || s_nationkey || '> \\\"q\\\"\\\\ y\"' AS dot FROM supplier")
def diagram_labels(spark, sf):
    s = F.concat(F.lit("#"), "s_name", F.lit("<"), F.col("s_nationkey").cast("string"), F.lit('> "q"\\\r\n y'))
    return T.table(spark, sf, "supplier").select("s_suppkey", X.mermaid_label(s).alias("mermaid"), X.dot_string(s).alias("dot"))


DRAWN = f"""WITH {EDGES}, {DECLARED}, c AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), n AS (SELECT n_nationkey AS ord, n_name AS name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS files, n_nationkey % 3 AS p FROM nation),
s AS (SELECT coalesce(d.src, c.src) AS src, coalesce(d.dst, c.dst) AS dst, CASE WHEN c.src IS NULL THEN 'unused' WHEN d.src IS NULL THEN 'undeclared' ELSE 'used' END AS state FROM d FULL JOIN c ON d.src = c.src AND d.dst = c.dst),
x AS (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS k, CASE state WHEN 'undeclared' THEN 'not declared' WHEN 'unused' THEN 'reads "' || dst || '" (no import)' ELSE 'reads "' || dst || '"' END AS label FROM s WHERE src < 25 AND dst < 25),
m AS (SELECT *, name || ' (' || files || CASE files WHEN 1 THEN ' file)' ELSE ' files)' END AS label, CASE p WHEN 0 THEN 'closed, no public file' WHEN 1 THEN 'public: a.ts' ELSE 'public: a.ts, b.ts' END AS pub FROM n)"""


def _drawn(spark, sf):
    t = lambda name: T.table(spark, sf, name)
    files = t("supplier").groupBy(F.col("s_nationkey").alias("ord")).agg(F.count("*").alias("files"))
    public = F.expr("CASE ord % 3 WHEN 0 THEN cast(array() as array<string>) WHEN 1 THEN array('a.ts') ELSE array('a.ts', 'b.ts') END")
    n = t("nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name")).join(files, "ord", "left").fillna(0, ["files"]).withColumn("public", public)
    names = n.select("ord", "name")
    e = G.edge_state(spark, sf).join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
    return n, e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "state", F.concat(F.lit('reads "'), F.col("dst").cast("string"), F.lit('"')).alias("reason"))


@query(f"""{DRAWN} SELECT 0 AS section, 0 AS k, 'flowchart TB' AS text UNION ALL SELECT 1, 0, '  subgraph p0["root"]' UNION ALL SELECT 2, ord * 2, '    %% ' || name || ' ' || pub FROM m
UNION ALL SELECT 2, ord * 2 + 1, '    p0_b' || ord || '["' || label || '"]' FROM m UNION ALL SELECT 3, 0, '  end'
UNION ALL SELECT 4, k, '  p0_b' || src || CASE state WHEN 'used' THEN ' -->' ELSE ' -.->' END || '|"' || replace(label, '"', '#quot;') || '"| p0_b' || dst FROM x
UNION ALL SELECT 5, 0, '  linkStyle ' || string_agg(k, ',' ORDER BY k) || ' stroke-dasharray:6 4' FROM x WHERE state = 'unused' HAVING count(*) > 0
UNION ALL SELECT 6, 0, '  linkStyle ' || string_agg(k, ',' ORDER BY k) || ' stroke:#d1242f,stroke-dasharray:2 4' FROM x WHERE state = 'undeclared' HAVING count(*) > 0""")
def mermaid_document(spark, sf):
    return diagrams.mermaid(*_drawn(spark, sf), "root")


@query(f"""{DRAWN} SELECT 0 AS section, 0 AS k, 'digraph groups {{' AS text UNION ALL SELECT 1, 0, '  rankdir=TB;' UNION ALL SELECT 2, 0, '  node [shape=box];' UNION ALL SELECT 3, 0, '  subgraph cluster_p0 {{' UNION ALL SELECT 4, 0, '    label="root";'
UNION ALL SELECT 5, ord, '    p0_b' || ord || ' [label="' || label || '", tooltip="' || pub || '"];' FROM m UNION ALL SELECT 6, 0, '  }}'
UNION ALL SELECT 7, k, '  p0_b' || src || ' -> p0_b' || dst || ' [label="' || replace(label, '"', '\\"') || '"' || CASE state WHEN 'used' THEN '' WHEN 'unused' THEN ', style=dashed' ELSE ', style=dotted, color="#d1242f", fontcolor="#d1242f"' END || '];' FROM x
UNION ALL SELECT 8, 0, '}}'""")
def dot_document(spark, sf):
    return diagrams.dot(*_drawn(spark, sf), "root")


JUDGED = "b AS (SELECT scenario, CASE WHEN length(scenario) % 2 = 0 THEN 50.0 END AS budget, CASE WHEN length(scenario) % 3 > 0 THEN 0.4 ELSE 0 END AS was FROM s)"


@query(f"WITH s AS ({G.SQL['bench_summary']}), {JUDGED}, t AS (SELECT scenario, CASE WHEN p95 > budget THEN 'p95 ' || regexp_replace(p95::DECIMAL(30,1)::VARCHAR, '\\.0$', '') || ' ms is over the budget of 50 ms' END AS o, CASE WHEN was > 0 AND median > was * 1.2 THEN 'median ' || regexp_replace(median::DECIMAL(30,1)::VARCHAR, '\\.0$', '') || ' ms is ' || floor((median / 0.4 - 1) * 100 + 0.5)::BIGINT || '% over the baseline of 0.4 ms' END AS w FROM s JOIN b USING (scenario)) SELECT scenario, concat_ws('; ', o, w) AS reasons FROM t")
def baseline_judge(spark, sf):
    s = G.bench_summary(spark, sf)
    was = F.when(F.length("scenario") % 3 > 0, 0.4).otherwise(0.0)
    b = s.select("scenario", F.when(F.length("scenario") % 2 == 0, 50.0).alias("budget"), was.alias("was"))
    return stats.judge(s, b).select("scenario", F.array_join("reasons", "; ").alias("reasons"))


@query("SELECT s_nationkey AS grp, p_brand AS name, min(l_suppkey) AS file FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def first_exports(spark, sf):
    t = lambda n: T.table(spark, sf, n)
    public = t("supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("ord"), F.col("s_suppkey").alias("file"))
    j = t("lineitem").select("l_suppkey", "l_partkey").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return relations.first_export(public, j.select(F.col("l_suppkey").alias("file"), F.col("p_brand").alias("name")))


@query(f"WITH {FILES}, p AS (SELECT path || CASE length(path) % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '/declared.json' WHEN 2 THEN '/tsconfig.json' WHEN 3 THEN '/node_modules/x.ts' WHEN 4 THEN '.d.mts' ELSE '.md' END AS q, length(path) % 6 AS n, path FROM f) SELECT DISTINCT CASE n WHEN 1 THEN 'config' WHEN 2 THEN 'settings' ELSE 'source' END AS kind, CASE WHEN n IN (1, 2) THEN path ELSE q END AS path FROM p WHERE n IN (0, 1, 2, 4)")
def classified_paths(spark, sf):
    more = F.expr("CASE length(path) % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '/declared.json' WHEN 2 THEN '/tsconfig.json' WHEN 3 THEN '/node_modules/x.ts' WHEN 4 THEN '.d.mts' ELSE '.md' END")
    return sources.classify(T.page_files(spark, sf).select(F.concat("path", more).alias("path")), "declared.json")


DRAW = "('0x' || left(md5('7/' || {0}), 7))::BIGINT"


@query(f"SELECT 'src/b' || g || '/' || CASE k WHEN 0 THEN 'index' ELSE 'f' || k END || CASE WHEN {DRAW.format(chr(39) + 'ending/' + chr(39) + ' || g || ' + chr(39) + '/' + chr(39) + ' || k')} % 5 = 0 THEN '.tsx' ELSE '.ts' END AS path, g AS grp FROM (SELECT s_suppkey AS g FROM supplier) a, range(25) b(k)")
def seeded_files(spark, sf):
    return sources.project_files(T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("grp")), 25, 7)


@query(f"WITH i AS (SELECT g AS src, k, l AS line, g || '/' || k || '/' || l AS s FROM (SELECT s_suppkey AS g FROM supplier) a, range(25) b(k), range(1, 4) c(l)) SELECT src, k, line, {DRAW.format(chr(39) + 'dst/' + chr(39) + ' || s')} % 40 AS dst, {DRAW.format(chr(39) + 'private/' + chr(39) + ' || s')} % 10 = 0 AS private FROM i")
def seeded_imports(spark, sf):
    return sources.project_imports(T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("grp")), 25, 3, 40, 7)


@query("""WITH e AS (SELECT 'f' || l_orderkey AS file, l_linenumber AS line, CASE l_partkey % 9 WHEN 0 THEN '..' WHEN 1 THEN './a/.' ELSE './m' || l_suppkey || CASE l_partkey % 2 WHEN 0 THEN '.js' ELSE '' END END AS specifier, 'm' || l_suppkey AS target, CASE l_partkey % 11 WHEN 0 THEN 'dynamic' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'outside' ELSE 'file' END AS kind, l_orderkey, l_suppkey, l_partkey FROM lineitem)
SELECT file, line, specifier, target FROM e WHERE kind <> 'dynamic' AND l_orderkey % 13 <> 0 AND l_orderkey % 17 <> 0
AND (l_suppkey % 10 = 3 OR kind = 'unresolved' OR l_partkey % 9 < 2 OR (l_partkey % 9 > 1 AND l_suppkey % 10 = 4))""")
def stale_imports(spark, sf):
    t = lambda n: T.table(spark, sf, n)
    e = t("lineitem").selectExpr(
        "concat('f', l_orderkey) AS file", "l_linenumber AS line", "CASE l_partkey % 9 WHEN 0 THEN '..' WHEN 1 THEN './a/.' ELSE concat('./m', l_suppkey, CASE l_partkey % 2 WHEN 0 THEN '.js' ELSE '' END) END AS specifier",
        "concat('m', l_suppkey) AS target", "CASE l_partkey % 11 WHEN 0 THEN 'dynamic' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'outside' ELSE 'file' END AS kind",
    )
    path = lambda f, where, text: f.where(where).select(F.expr(text).alias("path"))
    removed = path(t("supplier"), "s_suppkey % 10 = 3", "concat('m', s_suppkey)").unionByName(path(t("orders"), "o_orderkey % 13 = 0", "concat('f', o_orderkey)"))
    added = path(t("supplier"), "s_suppkey % 10 = 4", "concat('lib/m', s_suppkey, '.d.ts')")
    return sources.stale_edges(e, removed, added, path(t("orders"), "o_orderkey % 17 = 0", "concat('f', o_orderkey)"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || ', b, new' WHEN 1 THEN p_brand || ', b, theirs' ELSE 'b' END AS merged FROM part")
def merged_sets(spark, sf):
    base = F.array(F.lit("b"), F.lit("c"), F.lit("d"))
    ours = F.when(F.expr("p_partkey % 3 = 0"), F.array(F.lit("new"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("b"), F.lit("c")))
    theirs = F.when(F.expr("p_partkey % 3 = 0"), F.array(F.lit("b"), F.col("p_brand"))).when(F.expr("p_partkey % 3 = 1"), F.array(F.lit("theirs"), F.col("p_brand"), F.lit("d"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("d")))
    return T.table(spark, sf, "part").select("p_partkey", F.array_join(diff.list_merge(base, ours, theirs), ", ").alias("merged"))


@query("SELECT o_custkey, CASE n WHEN 1 THEN a[1] ELSE array_to_string(a[1:n-1], ', ') || ' and ' || a[n] END AS names FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderkey::VARCHAR)) AS a, len(a) AS n FROM orders GROUP BY o_custkey)")
def joined_names(spark, sf):
    names = T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.col("o_orderkey").cast("string"))).alias("names"))
    return names.select("o_custkey", P.join_and(F.col("names")).alias("names"))


#: A source for each part, of five lines; the second import of the first line stands in a comment.
SOURCE = "concat('import d, { a as b, type T', p_size, ' } from \"./m', p_partkey, '\"; // import \"./no\"\n', 'const s = \\'export * from \"x\"\\'\n', 'export { n', p_size, ' as q } from \"', p_brand, '\"\n', 'const { z } = await import(`./l/', p_partkey, '`)\n', 'export function f', p_partkey % 9, '() { return require(\"k\") }')"


def _sources(spark, sf):
    return T.table(spark, sf, "part").select(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"), F.expr(SOURCE).alias("text"))


@query("SELECT 'src/p' || p_partkey || '.ts' AS path, kind, specifier, line::INT AS line, star, names FROM part, LATERAL (VALUES ('static', './m' || p_partkey, 1, false, 'default,a,type T' || p_size), ('static', p_brand, 3, false, 'n' || p_size), ('dynamic', './l/' || p_partkey, 4, false, 'z'), ('require', 'k', 5, true, '')) t(kind, specifier, line, star, names)")
def scanned_imports(spark, sf):
    names = F.array_join(F.transform("names", lambda n: F.concat(F.when(n["type_only"], "type ").otherwise(""), n["name"])), ",")
    return scanner.scan_files(_sources(spark, sf)).select("path", "kind", "specifier", "line", "star", names.alias("names"))


@query("SELECT 'src/p' || p_partkey || '.ts' AS path, name, line::INT AS line, false AS type_only FROM part, LATERAL (VALUES ('q', 3), ('f' || p_partkey % 9, 5)) t(name, line)")
def scanned_exports(spark, sf):
    return scanner.scan_files(_sources(spark, sf), "exports")


#: A source for each part whose lines depend on it: what it passes on, what code it holds, and how many blank lines come first.
VARIED = r"""concat(repeat('\n', p_partkey % 4),
CASE WHEN p_partkey % 3 = 0 THEN concat('export { a, b as c', p_partkey % 7, ' } from "../g', (p_partkey + 1) % 10, '/m', p_partkey + 1, '"') ELSE '/* export * from "no" */' END, '\n',
CASE p_partkey % 4 WHEN 0 THEN concat('export * from "./m', p_partkey + 10, '"') WHEN 1 THEN concat('export * as ns from "../g', (p_partkey + 3) % 10, '/m', p_partkey + 3, '"') ELSE '// none' END, '\n',
CASE p_partkey % 5 WHEN 0 THEN concat('export const v', p_partkey % 6, ' = `x${ {} }`') WHEN 1 THEN 'if (x) { run(/[`/]/) }' WHEN 2 THEN concat('import d, { type T } from "./m', p_partkey + 20, '"') WHEN 3 THEN concat('const { k', p_partkey % 3, ': z, ...r } = await import("./m', p_partkey + 30, '")') ELSE ';' END, '\n',
CASE p_partkey % 6 WHEN 0 THEN concat('import("./m', p_partkey + 40, '").then(function ({ q', p_partkey % 4, ' }) {})') WHEN 1 THEN concat('export type { U } from "../g', (p_partkey + 2) % 10, '/m', p_partkey + 2, '"') ELSE '' END)"""
VARIED_SQL = """v AS (SELECT p_partkey AS p, 'src/g' || (p_partkey % 10) || '/m' || p_partkey || '.ts' AS path, 1 + p_partkey % 4 AS s FROM part),
st AS (SELECT p, path, 'static' AS kind, '../g' || ((p + 1) % 10) || '/m' || (p + 1) AS specifier, s AS line, false AS star, true AS again, 'a,b' AS names, p + 1 AS target FROM v WHERE p % 3 = 0
UNION ALL SELECT p, path, 'static', CASE p % 4 WHEN 0 THEN './m' || (p + 10) ELSE '../g' || ((p + 3) % 10) || '/m' || (p + 3) END, s + 1, true, true, '', CASE p % 4 WHEN 0 THEN p + 10 ELSE p + 3 END FROM v WHERE p % 4 < 2
UNION ALL SELECT p, path, 'static', './m' || (p + 20), s + 2, false, false, 'default,type T', p + 20 FROM v WHERE p % 5 = 2
UNION ALL SELECT p, path, 'dynamic', './m' || (p + 30), s + 2, true, false, '', p + 30 FROM v WHERE p % 5 = 3
UNION ALL SELECT p, path, 'dynamic', './m' || (p + 40), s + 3, false, false, 'q' || (p % 4), p + 40 FROM v WHERE p % 6 = 0
UNION ALL SELECT p, path, 'static', '../g' || ((p + 2) % 10) || '/m' || (p + 2), s + 3, false, true, 'type U', p + 2 FROM v WHERE p % 6 = 1),
co AS (SELECT p, path, s + 2 AS line FROM v WHERE p % 5 < 4 UNION ALL SELECT p, path, s + 3 FROM v WHERE p % 6 = 0)"""


def _varied(spark, sf):
    return T.table(spark, sf, "part").selectExpr("concat('src/g', p_partkey % 10, '/m', p_partkey, '.ts') AS path", f"{VARIED} AS text")


@query(f"WITH {VARIED_SQL} SELECT path, kind, specifier, line, star, again AS reexport, names FROM st")
def scanned_statements(spark, sf):
    names = F.array_join(F.transform("names", lambda n: F.concat(F.when(n["type_only"], "type ").otherwise(""), n["name"])), ",")
    return scanner.scan_files(_varied(spark, sf)).select("path", "kind", "specifier", "line", "star", "reexport", names.alias("names"))


@query(f"WITH {VARIED_SQL} SELECT path, line FROM co")
def scanned_code(spark, sf):
    return scanner.scan_files(_varied(spark, sf), "code")


@query(f"""WITH {VARIED_SQL}, u AS (SELECT * FROM v WHERE p % 7 < 4)
SELECT (u.p % 10)::INT AS grp, u.path AS file, min(line) AS line, 'code' AS kind, NULL AS specifier, NULL AS source, NULL::INT AS source_grp FROM u JOIN co USING (p) GROUP BY u.p, u.path
UNION ALL SELECT u.p % 10, u.path, line, 'export-star', specifier, NULL, NULL FROM u JOIN st USING (p) WHERE again AND star
UNION ALL SELECT u.p % 10, u.path, line, 'foreign-reexport', NULL, x.path, x.p % 10 FROM u JOIN st USING (p) JOIN v x ON x.p = st.target WHERE again AND x.p % 10 <> u.p % 10 AND (star OR NOT (u.p % 10 % 4 = 0 AND (u.p % 10 * 3 + x.p % 10) % 5 < 3))""")
def public_not_interface(spark, sf):
    """Public files that are more than an interface: their text scanned, re-exports resolved, owners joined."""
    files = _varied(spark, sf)
    scanned = scanner.scan_files(files).where("reexport").selectExpr("path AS file", "line", "specifier", "star")
    owner = F.regexp_extract("path", "/g([0-9]+)/", 1).cast("int").alias("grp")
    owners = files.select(F.col("path").alias("file"), owner)
    k = F.regexp_extract("path", "/m([0-9]+)", 1).cast("int")
    public = files.where(k % 7 < 4).select(owner, F.col("path").alias("file"))
    groups = T.table(spark, sf, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("grp"))
    declared = groups.select(F.col("grp").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("dst")).where("src <> dst and (src * 3 + dst) % 5 < 3")
    resolved = resolve.resolve_relative(scanned, files)
    return R.public_not_interface(public, scanner.scan_files(files, "code").withColumnRenamed("path", "file"), resolved, owners, groups.where("grp % 4 = 0"), declared)
