"""The graph store against a full rebuild after random changes, and what a change writes."""

import random
from pathlib import Path

import pytest

from concord.operators import specifiers
from concord.streaming.store import GraphStore

CHANGES = "path string, text string, deleted boolean, seq int"


def resolver(spark):
    d = spark.createDataFrame
    settings, patterns = d([("", "src"), ("src/alias", None)], "folder string, base string"), d([("", "@/*", 0, ["src/none/*", "src/*"]), ("src/alias", "~*", 0, ["src/*"])], "settings string, pattern string, position int, targets array<string>")
    workspaces, installed, linked, answers = d([("ws", "packages/ws")], "name string, folder string"), d([("", "react")], "folder string, name string"), d([], "name string"), d([("src/a", "ws", "src/a/m0.ts")], "folder string, specifier string, target string")
    return lambda imports, listing: specifiers.resolve(imports, listing, settings, patterns, workspaces, installed, linked, answers)


def text(r):
    line = lambda: r.choice([
        f"import {{ a{r.randrange(3)} }} from './m{r.randrange(6)}'", f"import x from '../{r.choice('abc')}/m{r.randrange(6)}.js'", f"export * from '@/{r.choice('abc')}/m{r.randrange(6)}'", f"import('{r.choice('abc')}/m{r.randrange(6)}')",
        "import '..'", f"import '../{r.choice('abc')}'", "import(x)", "import 'react'", "import 'fs'", "import 'ws'", "import './style.css'", "const z = 1", f"import '~a/m{r.randrange(6)}'", "import 'd/x'",
    ])
    return "\n".join(line() for _ in range(r.randrange(5)))


def path(r):
    folder = r.choice(["src/a", "src/b", "src/c", "src/alias", "src"])
    return f"{folder}/{r.choice([f'm{r.randrange(6)}.ts', f'm{r.randrange(6)}.js', f'm{r.randrange(4)}/index.ts', 'index.ts', 'style.css', f'm{r.randrange(6)}.tsx'])}"


def table(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string").repartition(2)


def whole(store):
    return sorted(map(str, store.edges().collect())), sorted(map(tuple, store.files().collect()))


def parts(store, name):
    return {f.parent.name: {g.name for g in f.parent.glob("*.parquet")} for f in Path(store.path, name).glob("part=*/*.parquet")}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    r = random.Random(4)
    files = {path(r): text(r) for _ in range(25)}
    store = GraphStore(spark, str(tmp_path_factory.mktemp("graph")), resolver(spark), 16)
    store.build(table(spark, files))
    return r, files, store


def rebuilt(spark, files, tmp_path):
    other = GraphStore(spark, str(tmp_path), resolver(spark), 5)
    other.build(table(spark, files))
    return whole(other)


def test_changes_equal_a_rebuild(spark, made, tmp_path):
    r, files, store = made
    for step in range(4):
        rows, before = [], {n: parts(store, n) for n in ("edges", "files")}
        for seq in range(r.randrange(1, 5)):
            p = r.choice(sorted(files)) if r.random() < 0.6 else path(r)
            rows.append((p, None, True, seq) if r.random() < 0.4 else (p, text(r), False, seq))
        if step == 2:
            rows = [("src/d/new.ts", "import './gone'", False, 0), ("src/style.css", "a", False, 1)]  # a folder that a package's name becomes
        if step == 3:
            rows = [("src/d/new.ts", None, True, 0), ("src/style.css", None, True, 1)]
        counts = store.apply(spark.createDataFrame(rows, CHANGES))
        for p, t, gone, _ in sorted(rows, key=lambda x: x[3]):
            files.pop(p, None)
            if not gone:
                files[p] = t
        assert whole(store) == rebuilt(spark, files, tmp_path / str(step)), (step, rows)
        moved = {k for k in before["edges"].keys() | parts(store, "edges").keys() if before["edges"].get(k) != parts(store, "edges").get(k)}
        assert len(moved) <= counts["parts"] < 16 and len({k for k in before["files"] if before["files"][k] != parts(store, "files").get(k)}) <= len(rows)


def test_no_change_writes_nothing(spark, made):
    _, files, store = made
    before = {n: parts(store, n) for n in ("edges", "files")}
    some = sorted(files)[0]
    assert not any(store.apply(spark.createDataFrame([(some, "new", False, 0), (some, files[some], False, 1), ("no/such.ts", None, True, 0)], CHANGES)).values())
    assert not any(store.reconcile(table(spark, files)).values())
    assert {n: parts(store, n) for n in before} == before


def test_lost_events_are_found(spark, made, tmp_path):
    r, files, store = made
    some = sorted(files)
    del files[some[0]]
    files[some[1]] = "import './m1'\nimport '../a/m2'"
    files["src/a/late.ts"] = "export * from './m0'"
    counts = store.reconcile(table(spark, files))
    assert (counts["added"], counts["changed"], counts["removed"]) == (1, 1, 1)
    assert whole(store) == rebuilt(spark, files, tmp_path)


def test_cut_short_and_made_again(spark, made, tmp_path, monkeypatch):
    _, files, store = made
    write, rows = store._write, [("src/a/m0.ts", "import './m1'", False, 0), ("src/a/m9.ts", "import './m0'", False, 1)]
    monkeypatch.setattr(store, "_write", lambda rows, key, name, part: write(rows, key, name, part) if name == "edges" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.apply(spark.createDataFrame(rows, CHANGES))
    monkeypatch.undo()
    store.apply(spark.createDataFrame(rows, CHANGES))
    files |= {p: t for p, t, *_ in rows}
    assert whole(store) == rebuilt(spark, files, tmp_path)


def test_settings_ask_for_all(spark, made):
    _, _, store = made
    counts = store.apply(spark.createDataFrame([("tsconfig.json", "{}", False, 0)], CHANGES))
    assert counts["asked"] == store.edges().where("literal").count() and counts["parts"] == 1


def test_stream(spark, made, tmp_path):
    _, files, store = made
    spark.createDataFrame([("src/b/s.ts", "import './m0'", False, 0), ("src/b/s.ts", "import '../a/m0'", False, 1)], CHANGES).write.parquet(str(tmp_path / "in"))
    q = store.stream(spark.readStream.schema(CHANGES).parquet(str(tmp_path / "in")), str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r.specifier for r in store.edges().where("file = 'src/b/s.ts'").collect()] == ["../a/m0"]
