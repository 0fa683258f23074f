"""Problems of declarations by hand: every kind with its path, and the gate."""

import json

from concord.operators import declarations as D

FINE = {"version": "2.0", "groups": {"a": {"purpose": "p", "files": ["x/**"], "public": "a/i.ts", "dependsOn": {"b": "why"}, "packages": {"lodash": "r"}}, "b": {"purpose": "q", "files": ["y"], "public": None, "dependsOn": {}, "packages": {}, "external": "e"}}}
BAD = {
    "$schema": 5, "extra": {"purpose": 1}, "ignore": ["", "a\nb", 3], "projects": ["*", "..", "ok"],
    "groups": {"A!": {"purpose": " ", "files": [], "public": ["a", "x*", "", "..", "./a"], "dependsOn": {"zz": "", "A!": "l\nm"}, "packages": {"lodash/x": "r", "fs": "r"}, "odd": 1}, "c": 7},
}


def test_problems(spark):
    rows = [("fine", "﻿" + json.dumps(FINE)), ("new", json.dumps(FINE | {"version": "3.0", "x": 1})), ("old", json.dumps(FINE | {"version": "1.0"})), ("text", "{"), ("null", None), ("list", "[1]"), ("bad", json.dumps(BAD))]
    d = spark.createDataFrame(rows, "project string, text string").repartition(3)
    found = D.problems(d)
    got = {(r.project, r.kind, "/".join(r.path), r.detail) for r in found.collect()}
    assert {x for x in got if x[0] != "bad"} == {("new", "newer", "version", "3.0"), ("old", "invalid", "version", "a version"), ("text", "json", "", None), ("null", "json", "", None), ("list", "invalid", "", "a value of type object")}
    assert {x[1:] for x in got if x[0] == "bad"} == {
        ("missing", "", "version"), ("unknown-field", "", "extra"), ("unknown-field", "groups/A!", "odd"), ("invalid", "$schema", "a value of type string"), ("empty", "ignore/0", None), ("multiline", "ignore/1", None),
        ("invalid", "ignore/2", "a value of type string"), ("invalid", "projects/0", "a folder without glob characters"), ("invalid", "projects/1", "a folder inside this project"), ("group-name", "groups/A!", "A!"),
        ("empty", "groups/A!/purpose", None), ("empty", "groups/A!/files", None), ("invalid", "groups/A!/public/1", "a file without glob characters"), ("empty", "groups/A!/public/2", None),
        ("invalid", "groups/A!/public/3", "a file inside this project"), ("invalid", "groups/A!/public/4", "a file that the list does not hold already"), ("empty", "groups/A!/dependsOn/zz", None), ("unknown-group", "groups/A!/dependsOn/zz", "zz"),
        ("multiline", "groups/A!/dependsOn/A!", None), ("package-name", "groups/A!/packages/lodash/x", "lodash"), ("package-name", "groups/A!/packages/fs", "node:fs"), ("invalid", "groups/c", "a value of type object"),
    }
    assert [r.project for r in D.sound(d, found).collect()] == ["fine"]
    assert D.problems(d.limit(0)).count() == 0


def test_values_tell_their_keys_and_items(spark):
    rows = [("p", json.dumps({"b": [1, None], "a": {}, "c": [], "d": "x"}))]
    values = {"/".join(r.path): (r["keys"] and sorted(r["keys"]), r["items"]) for r in D.walk(spark.createDataFrame(rows, "project string, text string")).collect() if len(r.path) < 2}
    assert values == {"": (["a", "b", "c", "d"], None), "a": ([], None), "b": (None, 2), "c": (None, 0), "d": (None, None)}
