"""The tiers of specifier resolution, each case by hand, and workspace folders."""

import pytest

from concord.operators import specifiers as S

FILES = ["src/a.ts", "src/b/index.tsx", "src/c.d.ts", "src/deep/in/x.js", "src/lib/util.mts", "shared/only.ts", "src/both.ts", "shared/both.ts", "packages/core/src/index.ts", "index.ts", "web/page.tsx", "src/name.test.ts"]
UNLISTED = ["src/app.css", "src/gen/made.ts", "shared/logo.svg"]
SETTINGS = [("", None), ("src", "src"), ("web", None)]
PATTERNS = [
    ("src", "@lib/*", 0, ["lib/*", "src/lib/*"]), ("src", "@lib/deep/*", 1, ["src/deep/*"]), ("src", "exact", 2, ["src/a"]), ("src", "@s/*.x", 3, ["shared/*"]),
    ("src", "@s/*", 4, ["src/none/*"]), ("web", "*", 0, ["shared/*"]), ("src", "@svg/*", 5, ["shared/*"]), ("src", "fsx*", 6, ["nowhere/*"]), ("src", "ws-core/*", 7, ["nowhere/*"]),
]
WORKSPACES = [("ws-core", "packages/core"), ("@ws/ui", "packages/ui")]
INSTALLED = [("", "react"), ("src/deep", "only-deep"), ("", "lib"), ("", "fsx-real")]
LINKED = [("linked",)]
ANSWERS = [("src", "ws-core", "packages/core/src/index.ts"), ("src", "#inner", "src/a.ts"), ("src", "linked/x", "src/gen/made.ts"), ("src", "react", "src/a.ts")]

CASES = [
    ("src/m.ts", "./a", "file", "src/a.ts", None), ("src/m.ts", "./a.js", "file", "src/a.ts", None), ("src/m.ts", "./b", "file", "src/b/index.tsx", None), ("src/m.ts", "./b/", "file", "src/b/index.tsx", None),
    ("src/m.ts", "./a/", "relative", None, None), ("src/m.ts", "./c", "file", "src/c.d.ts", None), ("src/m.ts", "./lib/util.mjs", "file", "src/lib/util.mts", None), ("src/m.ts", "..", "file", "index.ts", None),
    ("src/m.ts", "./a.ts?raw", "file", "src/a.ts", None), ("src/m.ts", "./gone", "relative", None, None), ("src/m.ts", "../../out", "relative", None, None), ("src/m.ts", "./app.css", "other", None, None),
    ("src/m.ts", "./gen/made", "other", None, None), ("src/m.ts", "./app.css?url", "other", None, None), ("m.ts", "./src/a", "file", "src/a.ts", None), ("src/m.ts", "./name.test", "file", "src/name.test.ts", None),
    ("src/m.ts", "", "other", None, None), ("src/m.ts", "/a", "other", None, None), ("src/m.ts", "C:/a", "other", None, None), ("src/m.ts", None, "other", None, None), ("src/m.ts", ".hidden", "package", ".hidden", None),
    ("src/m.ts", "node:fs", "builtin", "node:fs", None), ("src/m.ts", "fs", "builtin", "fs", None), ("src/m.ts", "fs/promises", "builtin", "fs/promises", None), ("src/m.ts", "fs/other", "package", "fs", None),
    ("src/m.ts", "@lib/util.mjs", "file", "src/lib/util.mts", None), ("src/m.ts", "@lib/gone", "paths", None, "@lib/*"), ("src/m.ts", "@lib/deep/in/x", "file", "src/deep/in/x.js", None), ("src/m.ts", "exact", "file", "src/a.ts", None),
    ("src/m.ts", "@s/only.x", "file", "shared/only.ts", None), ("src/m.ts", "@s/only", "paths", None, "@s/*"), ("src/m.ts", "@svg/logo.svg?url", "other", None, None), ("src/m.ts", "fsx-real", "package", "fsx-real", None),
    ("src/m.ts", "fsx-not", "paths", None, "fsx*"), ("src/m.ts", "ws-core/y", "workspace", None, None), ("web/m.ts", "only", "file", "shared/only.ts", None), ("web/m.ts", "none", "package", "none", None), ("web/m.ts", "os", "builtin", "os", None),
    ("src/m.ts", "lib/util.mjs", "file", "src/lib/util.mts", None), ("src/m.ts", "deep/none", "paths", None, None), ("src/m.ts", "lib/none", "package", "lib", None), ("src/m.ts", "deep", "package", "deep", None),
    ("src/m.ts", "gen/made", "other", None, None), ("src/m.ts", "both", "file", "src/both.ts", None), ("m.ts", "a", "package", "a", None), ("src/m.ts", "#inner", "file", "src/a.ts", None), ("src/m.ts", "#none", "other", None, None),
    ("src/m.ts", "ws-core", "file", "packages/core/src/index.ts", None), ("src/m.ts", "@ws/ui", "workspace", None, None), ("src/m.ts", "linked/x", "workspace", None, None), ("src/m.ts", "linked", "workspace", None, None),
    ("src/m.ts", "react", "package", "react", None), ("src/m.ts", "react/jsx", "package", "react", None), ("src/deep/in/m.ts", "only-deep/x", "package", "only-deep", None), ("src/m.ts", "@scope/p/q", "package", "@scope/p", None),
    ("src/deep/in/m.ts", "exact", "file", "src/a.ts", None), ("other/m.ts", "@lib/util.mjs", "package", "@lib/util.mjs", None),
]


@pytest.fixture(scope="module")
def resolved(spark):
    d = spark.createDataFrame
    imports = d([(f, s, i) for i, (f, s, *_) in enumerate(CASES)] + [("src/m.ts", "./a", 1000)], "file string, specifier string, line int")
    listing = d([(f, True) for f in FILES] + [(f, False) for f in UNLISTED] + [(None, True)], "path string, listed boolean")
    out = S.resolve(
        imports.repartition(3), listing, d(SETTINGS, "folder string, base string"), d(PATTERNS, "settings string, pattern string, position int, targets array<string>"), d(WORKSPACES, "name string, folder string"),
        d(INSTALLED, "folder string, name string"), d(LINKED, "name string"), d(ANSWERS, "folder string, specifier string, target string"),
    )
    return {r.line: (r.kind, r.target, r.pattern) for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_tier(resolved, i):
    assert resolved[i] == CASES[i][2:], CASES[i]


def test_repeats(resolved):
    assert len(resolved) == len(CASES) + 1 and resolved[1000] == resolved[0]


def test_workspaces(spark):
    folders = ["packages/a", "packages/b", "packages/a/sub", "apps/x/y/z", "apps/1/2/3/4", "apps/1/2/3/4/5", "packages/node_modules/n", "packages/.dot", "tools", "packages/c", "apps"]
    packages = spark.createDataFrame([(f, f"n-{f}") for f in folders] + [("packages/d", ""), ("packages/e", None)], "folder string, name string")
    got = lambda *globs: {r.folder for r in S.workspaces(packages, list(globs)).collect()}
    assert got("packages/*") == {"packages/a", "packages/b", "packages/c"}
    assert got("packages/*", "!packages/b", "./tools/") == {"packages/a", "packages/c", "tools"}
    assert got("!packages/b", "packages/*") == {"packages/a", "packages/b", "packages/c"}
    assert got("apps/**") == {"apps", "apps/x/y/z", "apps/1/2/3/4"}
    assert got("**/sub") == {"packages/a/sub"} and got("../x", "packages/{a,b}", "packages/a*") == set() == got()


def test_imports_are_read_twice_at_most(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    imports = frame([(f"src/f{i}.ts", "@g/a" if i % 2 else "./b") for i in range(40)], "file string, specifier string").mapInPandas(count, "file string, specifier string")
    got = S.resolve(
        imports, frame([("src/b.ts", True), ("lib/a.ts", True)], "path string, listed boolean"), frame([("src", None)], "folder string, base string"),
        frame([("src", "@g/*", 0, ["lib/*"])], "settings string, pattern string, position int, targets array<string>"), frame([], "name string, folder string"),
        frame([], "folder string, name string"), frame([], "name string"), frame([], "folder string, specifier string, target string"),
    ).collect()
    assert {(r.specifier, r.kind, r.target) for r in got} == {("./b", "file", "src/b.ts"), ("@g/a", "file", "lib/a.ts")} and len(got) == 40
    assert seen.value <= 80
