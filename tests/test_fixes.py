"""The plan of re-exports against imports taken one by one, and nested projects by hand."""

import random

import pytest
from pyspark.sql import functions as F

from concord.operators import fixes, projects

IMPORTS = "grp int, place int, target string, names array<struct<name:string,as_type:boolean>>"
EXPORTED = "grp int, shown string, target string, name string, type_only boolean"


def shown(name, target):
    return target.removesuffix(".ts") if name == "default" else name


def one_by_one(imports, exported):
    have = {(g, s): (t, n, typed) for g, s, t, n, typed in exported}
    planned, fates = {}, {}
    for g, place, target, names in sorted(imports, key=lambda r: r[:2]):
        fate = "routed" if names else "no-names"
        for name, typed in names:
            key = (g, shown(name, target))
            if key in have and (have[key][:2] != (target, name) or have[key][2] and not typed):
                fate = "exported"
        if fate == "routed" and any((k := (g, shown(n, target))) not in have and k in planned and planned[k][:2] != (target, n) for n, _ in names):
            fate = "planned"
        if fate == "routed":
            for name, typed in names:
                key = (g, shown(name, target))
                if key not in have:
                    planned[key] = (target, name, typed and planned.get(key, (0, 0, True))[2])
        fates[g, place] = fate
    return {(*k, *v) for k, v in planned.items()}, fates


@pytest.mark.parametrize("seed", [1])
def test_plan(spark, seed):
    r = random.Random(seed)
    imports = [(g, p, f"t{r.randrange(4)}.ts", list({n: (n, r.random() < 0.4) for n in r.choices(["a", "b", "c", "d", "t1", "default"], k=r.choice([0, 1, 1, 2, 3]))}.values())) for g in range(3) for p in range(9)]
    exported = [(g, n, f"t{r.randrange(4)}.ts", n, r.random() < 0.5) for g in range(2) for n in ("a", "z")]
    added, fates = fixes.plan(spark.createDataFrame(imports, IMPORTS).repartition(3), spark.createDataFrame(exported, EXPORTED))
    want = one_by_one(imports, exported)
    assert ({tuple(x) for x in added.collect()}, {(x.grp, x.place): x.fate for x in fates.collect()}) == want
    assert {"routed", "exported", "planned"} <= set(want[1].values())


def test_two_clashes_in_one_file(spark):
    imports = [(1, 1, "x.ts", [("a", False)]), (1, 2, "y.ts", [("a", False), ("b", False)]), (1, 3, "z.ts", [("b", True)]), (1, 4, "z.ts", [("b", False)]), (1, 5, "y.ts", [("b", False)]), (1, 6, "q.ts", [("default", False)]), (1, 7, "w.ts", [("q", True)])]
    added, fates = fixes.plan(spark.createDataFrame(imports, IMPORTS), spark.createDataFrame([], EXPORTED))
    assert {x.place: x.fate for x in fates.collect()} == {1: "routed", 2: "planned", 3: "routed", 4: "routed", 5: "planned", 6: "routed", 7: "planned"}
    assert {tuple(x) for x in added.collect()} == {(1, "a", "x.ts", "a", False), (1, "b", "z.ts", "b", False), (1, "q", "q.ts", "default", False)}
    none = fixes.plan(spark.createDataFrame([], IMPORTS), spark.createDataFrame([], EXPORTED))
    assert [x.count() for x in none] == [0, 0]


def test_groups_and_reexported(spark):
    kind = "project string, src int, dst int, file string, line int, target string, names array<string>, private boolean"
    got = fixes.private_groups(spark.createDataFrame([("", 1, 2, "b.ts", 1, "t", ["x"], True)], kind), spark.createDataFrame([("", 3, 2, "a.ts", 9, "t", ["y"], True), ("", 3, 2, "a.ts", 8, "t", ["y"], False), ("p", 1, 2, "a.ts", 1, "t", [], True)], kind))
    assert sorted((r.project, r.dst, r.place, r.file, r.declared) for r in got.collect()) == [("", 2, 1, "a.ts", False), ("", 2, 2, "b.ts", True), ("p", 2, 1, "a.ts", False)]
    d = spark.createDataFrame
    have = d([(1, "i.ts", "a/x.ts", "a"), (1, "i.ts", "a/x.ts", "default"), (1, "i.ts", "a/y.ts", "default"), (1, "i.ts", "a/x.ts", "hidden")], "grp int, file string, target string, name string")
    exports = d([(1, "i.ts", "a"), (1, "i.ts", "x")], "grp int, file string, name string")
    asked = d([(1, "a/x.ts", n) for n in ("a", "default", "hidden", "other")] + [(1, "a/y.ts", "default"), (2, "a/x.ts", "a")], "grp int, target string, name string")
    assert sorted(map(tuple, fixes.reexported(asked, have, exports).collect())) == [(1, "a/x.ts", "a"), (1, "a/x.ts", "default")]


def test_projects(spark):
    d = spark.createDataFrame
    found = d([("", x) for x in ("", "pkg/a", "pkg/a/deep", "pkg/b", "gen/x", "pkg/ab", "top")] + [("o", "pkg/a")], "project string, folder string")
    declared = d([("", "pkg/a", "pkg/a"), ("", "./gone/", "gone"), ("", "top", "top")], "project string, written string, folder string")
    assert sorted(map(tuple, projects.undeclared_projects(found, declared, F.col("path").startswith("gen/")).collect())) == [("", "pkg/ab"), ("", "pkg/b"), ("o", "pkg/a")]
    assert [tuple(r) for r in projects.missing_projects(declared, found).collect()] == [("", "./gone/")]
    paths = d([("pkg/a/x.ts",), ("pkg/a/deep/y.ts",), ("z.ts",), ("pkg/ab/q.ts",)], "path string")
    assert {r.path: r.project for r in projects.assign(paths, d([("",), ("pkg/a",), ("pkg/a/deep",)], "project string")).collect()} == {"pkg/a/x.ts": "pkg/a", "pkg/a/deep/y.ts": "pkg/a/deep", "z.ts": "", "pkg/ab/q.ts": ""}
    checks = [d([("", "k1"), ("a", "k2")], "project string, key string"), d([("a", "k2"), ("a", "k9"), ("b", "k3")], "project string, key string")]
    covered = d([(0, ""), (0, "a"), (1, "a"), (1, "b")], "position int, project string")
    assert sorted(map(tuple, projects.united(checks, covered).collect())) == [("", "k1"), ("a", "k2"), ("b", "k3")]
