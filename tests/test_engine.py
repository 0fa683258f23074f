"""Functions, ownership, merges and streams on small hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from concord.functions import globs, paths
from concord.operators import components, diff, graph, ownership, rollup
from concord.streaming import changes


@pytest.mark.parametrize(
    ("p", "want"),
    [("a/./b//c", "a/b/c"), ("a\\b\\..\\c", "a/c"), ("../a", None), ("a/../..", None), ("", ""), ("a/..", ""), ("./a", "a")],
)
def test_normalize_path(spark, p, want):
    assert spark.range(1).select(paths.normalize_path(F.lit(p))).first()[0] == want


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("src/**/*.ts", ["src/a.ts", "src/x/y/a.ts"], ["src/a.js", "lib/src/a.ts"]),
        ("src/*", ["src/a"], ["src/a/b"]),
        ("src/**", ["src/a", "src/a/b"], ["src", "srcx/a"]),
        ("a?c", ["abc"], ["ac", "a/c"]),
        ("{a,b}/x", ["a/x", "b/x"], ["c/x"]),
        ("[!a]x", ["bx", "/x"], ["ax"]),
        ("[a&&b]", ["a", "&"], ["c"]),
        ("{a", ["{a"], ["a"]),
        ("[a", ["[a"], ["a"]),
        ("**/*.d.ts", ["a.d.ts", "x/a.d.ts"], ["adxts"]),
        ("a**b", ["axxb", "a/b"], ["a/c"]),
        ("{src/**,lib}", ["src/x/y.ts", "lib"], ["lib/x"]),
        ("./src/**", ["src/a"], ["lib/a"]),
        ("src/***", ["src/a/b.ts"], ["lib/a.ts"]),
        ("src/**.ts", ["src/a.ts", "src/a/b.ts"], ["src/a.js"]),
        ("src/**/a/**/*.ts", ["src/a/x.ts", "src/q/a/r/x.ts"], ["src/q/b/x.ts"]),
        ("**/x/**/y/**/*.ts", ["x/y/a.ts", "p/x/q/y/r/a.ts"], ["x/a.ts", "y/x/a.ts"]),
        ("src/*a*b*c*.ts", ["src/abc.ts", "src/xaybzc1.ts"], ["src/acb.ts", "src/a/bc.ts"]),
        ("a**b**c**d", ["abcd", "a/b/c/d", "axbxcxd"], ["abdc"]),
        ("{src,lib}/**/{a,b}*.ts", ["src/a.ts", "lib/x/b2.ts"], ["src/c.ts", "app/a.ts"]),
        ("**a" * 8 + "Z", ["a" * 30 + "Z"], ["a" * 200 + ".ts"]),
        ("src/" + "*a" * 20 + "Z", ["src/" + "a" * 30 + "Z"], ["src/" + "a" * 200 + ".ts"]),
    ],
)
def test_globs(spark, glob, yes, no):
    rx = globs.to_regex(glob)
    rows = spark.createDataFrame([(x,) for x in yes + no], "p string").withColumn("rx", F.lit(rx)).select("p", F.rlike("p", "rx")).collect()
    assert {p for p, ok in rows if ok} == set(yes)
    assert all(bool(re.match(rx, x)) for x in yes) and not any(re.match(rx, x) for x in no)


def test_ownership(spark):
    files = spark.createDataFrame([(p,) for p in ("a/x.ts", "a/t/x.ts", "a/t/keep.ts", "b/x.ts", "z.ts", "gen/a/x.ts", "ab/y.ts")], "path string")
    g = ownership.glob_table(spark, [("a", "a/**"), ("a", "!a/t/**"), ("a", "a/t/keep.ts"), ("b", "b/**"), ("ab", "ab/**"), ("ab", "{a,ab}/*.ts"), ("x", "!q/**"), (None, "gen/**"), ("g", "gen/**")])
    got = {r.path: (r.state, r.owner, r.owners) for r in ownership.owners(files, g).collect()}
    assert got == {
        "a/x.ts": ("overlap", None, "ab,a"), "a/t/x.ts": ("unowned", None, ""), "a/t/keep.ts": ("owned", "a", "a"), "b/x.ts": ("owned", "b", "b"),
        "z.ts": ("unowned", None, ""), "gen/a/x.ts": ("ignored", None, ""), "ab/y.ts": ("owned", "ab", "ab"),
    }
    hits = {r.glob_id: r.hits for r in ownership.glob_hits(files, g).collect()}
    assert hits == {0: 3, 1: 2, 2: 1, 3: 1, 4: 1, 5: 2, 6: 0, 7: 1, 8: 0}


def test_group_unowned(spark):
    rows = [(f"a/b/{i}", True) for i in range(3)] + [(f"a/c/{i}", True) for i in range(3)] + [("d/x", True), ("e/1", False), ("e/f/1", True), ("e/f/2", True), ("root", True), ("q/z", False)]
    group = lambda r, n: sorted(tuple(x) for x in rollup.group_unowned(spark.createDataFrame(r, "path string, flag boolean"), n).collect())
    # a is a top folder with folders; d has one file; q holds nothing unowned and does not count
    assert group(rows, 2) == [("a/b/**", 3), ("a/c/**", 3), ("d/x", None), ("e/f/**", 2), ("root", None)]
    # a chain of only folders below a top one is skipped, and so is one with over half of the files
    chain = [(f"a/b/c/{i}/{j}", True) for i in range(2) for j in range(3)] + [("z/y/1", True)]
    assert group(chain, 3) == [("a/b/c/0/**", 3), ("a/b/c/1/**", 3), ("z/y/1", None)]


def test_merge_lists(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert spark.range(1).select(diff.list_merge(a("x", "y", "z"), a("x", "z", "o"), a("x", "y", "t"))).first()[0] == ["o", "t", "x"]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1)] + [(100, 100 + i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 4)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 400)} | {i: 1000 for i in range(1000, 1101)}


def test_closure(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    got = {(r.src, r.dst): r.steps for r in graph.closure(e).collect()}
    assert got[1, 4] == 3 and got[1, 1] == 3 and (4, 1) not in got


def test_paths_to_the_end(spark):
    pairs = [(i, i + 1) for i in range(1, 9)] + [(1, 3), (4, 2), (5, 99), (5, 5), (1, 3), (9, 1)]
    e = spark.createDataFrame(pairs, "src int, dst int")

    def brute(path, b):
        if path[-1] == b:
            return [path]
        return [p for x, y in set(pairs) if x == path[-1] and y not in path for p in brute([*path, y], b)]

    assert sorted(r.path for r in graph.simple_paths(e, 1, 9).collect()) == sorted(brute([1], 9))  # 7 and 8 steps
    listed = graph.path_list(graph.simple_paths(e, 1, 9), 1).orderBy("place").collect()
    assert [r.path for r in listed] == sorted(brute([1], 9), key=lambda p: (len(p), p))[:1] and all(r.more for r in listed)
    assert graph.simple_paths(e, 99, 1).count() == 0


def test_graphs_to_the_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(8)], "src int, dst int")
    start, nodes = spark.createDataFrame([(0,)], "start int"), spark.createDataFrame([(i,) for i in range(10)], "node int")
    assert graph.shortest_paths(chain, start).count() == 8 and graph.layers(chain, nodes).agg(F.max("height")).first()[0] == 8
    ring = chain.unionByName(spark.createDataFrame([(8, 0), (9, 4)], "src int, dst int"))
    assert graph.representative_cycles(ring).first().path == [*range(9), 0]
    assert {r.node: r.height for r in graph.layers(ring, nodes).collect()} == {9: 1} | {i: 0 for i in range(9)}


def test_split_groups(spark):
    uses = [("f", "a", "x"), ("f", "b", "x"), ("f", "c", "y:z"), ("f:y", "c", "z"), ("g", "a", "x"), ("g", "b", "x"), ("h", "a", "x"), ("h", "b", "y"), ("h", "c", None)]
    got = graph.split_groups(spark.createDataFrame(uses, "file string, dependent string, name string")).collect()
    assert sorted(tuple(r) for r in got) == [("f", "a", "a"), ("f", "b", "a"), ("f", "c", "c")]


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    L = F.lit
    for path, want in (("a/my-file.d.ts", "myFile"), ("a/b/index.ts", "b"), ("index.ts", "index"), ("a/9-x.js", "_9X"), ("a/_p$.tsx", "_p$"), ("a/--.ts", "defaultExport"), ("a/x.test.ts", "xTest")):
        assert one(paths.default_export_name(L(path))) == want
    for public, target, want in (("a/index.ts", "a/b/c.ts", "./b/c"), ("a/b/index.ts", "a/c.d.ts", "../c"), ("index.ts", "x.js", "./x"), ("a/b/c.ts", "q/r.ts", "../../q/r"), ("a/b/c.ts", "a/b.ts", "../b")):
        assert one(paths.reexport_specifier(L(public), L(target))) == want
    for v, want in (("2.0", "supported"), ("2.1", "supported"), ("2.2", "newer"), ("3.0", "newer"), ("1.9", "invalid"), ("2", "invalid"), (None, "invalid"), ("99999999999.0", "invalid")):
        assert one(paths.version_status(L(v).cast("string"), 2, 1)) == want
    for s, key, sub in (("fs/promises", "node:fs", True), ("node:readline", "node:readline", False), ("worker_threads", "node:worker_threads", False), ("@s/p/x", "@s/p", True), ("lodash", "lodash", False)):
        assert (one(paths.package_key(L(s))), one(paths.is_subpath(L(s)))) == (key, sub)
    for kind, label, q, want in (("bucket", "ab", "AB", 0.5), ("bucket", "ab", "ab", 0.0), ("file", "x/abc", "ab", 1.0), ("export", "x/abc", "ab", 2.0), ("export", "xabc", "ab", 3.0), ("export", "x", "ab", None), ("export", "a b", "b", 3.0)):
        assert one(paths.match_score(L(kind), L(label), q)) == want, (kind, label)


def test_snapshot_equals_rebuild(spark):
    base = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "k int, v string")
    seen = []
    s = changes.Snapshot(base, "k", "seq", lambda df, i: seen.append(i))
    s.apply(spark.createDataFrame([(1, "x", False, 1), (1, "y", False, 2), (2, None, True, 3), (20, "n", False, 4)], "k int, v string, deleted boolean, seq int"), 0)
    s.apply(spark.createDataFrame([(1, "y", False, 5)], "k int, v string, deleted boolean, seq int"), 1)
    assert dict(map(tuple, s.now.collect())) == {i: f"v{i}" for i in range(10) if i != 2} | {1: "y", 20: "n"} and seen == [0]


def test_merge_conflict(spark):
    kv = lambda d: spark.createDataFrame(list(d.items()), "key string, value string")
    got = {r.key: (r.value, r.conflict) for r in diff.three_way_merge(kv({"a": "1", "b": "1", "c": "1", "d": "1"}), kv({"a": "2", "b": "1", "d": "5", "n": "x"}), kv({"a": "1", "b": "3", "c": "9", "d": "1"})).collect()}
    assert got == {"a": ("2", False), "b": ("3", False), "c": (None, True), "d": ("5", False), "n": ("x", False)}


def test_resolve(spark):
    from concord.operators import resolve

    files = spark.createDataFrame([("a/x.ts",), ("a/x.js",), ("b/index.tsx",), ("index.ts",), ("b/y.mts",), ("b/.js",), (None,)], "path string")
    asked = {
        ("a/q.ts", "./x"): "a/x.ts",
        ("a/q.ts", "./x.js"): "a/x.ts",
        ("a/q.ts", "./x.tsx"): None,
        ("a/q.ts", "../b"): "b/index.tsx",
        ("a/q.ts", "../b/"): "b/index.tsx",
        ("a/q.ts", ".."): "index.ts",
        ("a/q.ts", "../.."): None,
        ("b/q.ts", "./y.mjs"): "b/y.mts",
        ("q.ts", "./a/x"): "a/x.ts",
        ("q.ts", "a/x"): None,
        ("q.ts", None): None,
        (None, "./a/x"): None,
    }
    got = resolve.resolve_relative(spark.createDataFrame(list(asked), "file string, specifier string"), files).collect()
    assert {(r.file, r.specifier): r.target for r in got} == asked
    folders = spark.createDataFrame([("a",), ("",), ("a",)], "folder string")
    got = resolve.nearest_folder(files.where("path in ('a/x.ts', 'b/y.mts')"), folders).collect()
    assert {r.path: r.folder for r in got} == {"a/x.ts": "a", "b/y.mts": ""}
    got = resolve.best_pattern(spark.createDataFrame([("@a",), ("@a/b.css",), ("@a/b",), (None,), ("z",)], "specifier string"), spark.createDataFrame([("@a",), ("@*",), ("@a/*",), ("@a/*.css",)], "pattern string")).collect()
    assert {r.specifier: (r.pattern, r.star) for r in got} == {"@a": ("@a", None), "@a/b.css": ("@a/*.css", "b"), "@a/b": ("@a/*", "b")}
    kept = files.where(resolve.is_source(F.col("path"))).count()
    assert kept == 6


def test_edges_are_all_lines(spark):
    from concord import registry
    from concord.sources import tables

    sf = "/root/testdata/sf0.001"
    assert tables.edges(spark, sf).count() == tables.table(spark, sf, "lineitem").count()
    pairs = registry.queries()["pair_counts"](spark, sf).agg(F.sum("imports")).first()[0]
    assert pairs == tables.edges(spark, sf).where("src <> dst").count()
    assert "l_quantity" not in registry.oracle_sql()["pair_counts"]


def test_all_lines_are_resolved(spark):
    from concord import registry
    from concord.sources import tables

    sf = "/root/testdata/sf0.001"
    got = registry.queries()["resolved_imports"](spark, sf)
    assert "WHERE l_quantity" not in registry.oracle_sql()["resolved_imports"]
    l = tables.table(spark, sf, "lineitem")
    assert got.select("file").distinct().count() == l.select("l_partkey").distinct().count()
    assert got.count() == l.selectExpr("l_partkey", "l_suppkey * 3 + l_linenumber").distinct().count()


def test_small_tasks_only_lowers(spark):
    from concord.plans.shared import TASK_BYTES, small_tasks

    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    was = [spark.conf.get(k) for k in keys]
    try:
        for value, want in (("128m", TASK_BYTES), ("1g", TASK_BYTES), ("67108864b", TASK_BYTES), ("64MB", TASK_BYTES)):
            for k in keys:
                spark.conf.set(k, value)
            small_tasks(spark)
            assert [int(spark.conf.get(k)) for k in keys] == [want, want]
        for k in keys:
            spark.conf.set(k, "2m")
        small_tasks(spark)
        assert [spark.conf.get(k) for k in keys] == ["2m", "2m"]
    finally:
        for k, v in zip(keys, was, strict=True):
            spark.conf.set(k, v)
