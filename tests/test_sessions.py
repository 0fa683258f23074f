"""Sessions: single cases by hand, random ones against a plain retelling of the rules, and the stream against the table."""

import random

import pytest

from concord.streaming import sessions as S

PHASES = ["pre-edit", "pre-tool", "pre-tool", "stop", "subagent-stop", "post-compact"]


def event(session, agent, seq, phase, found=(), invalid=(), before=(), advice=(), applied=False, changes=False, config=False, active=False):
    return session, agent, seq, phase, sorted(found), sorted(invalid), sorted(before), sorted(advice), applied, changes, config, active


def told(rows):
    """The rules once more: each event's list is compared with lists kept in a dictionary of the session."""
    marks = [(r[0], "", r[2], "dirty") for r in rows if r[1] and (r[3] == "pre-tool" and r[9] or r[3] == "pre-edit" and not denied(r))]
    every = sorted([(r[0], r[1] or "", r[2], r[3] != "dirty", r) for r in rows] + [(m[0], m[1], m[2], False, m) for m in marks], key=lambda x: x[:4])
    now, out = {}, []
    for session, agent, seq, _, r in every:
        k = now.setdefault((session, agent), {"shown": [], "list": [], "due": False, "held": False, "last": [], "base": None, "told": []})
        phase = r[3]
        if phase == "dirty":
            k["due"], k["held"] = True, False
            continue
        found, invalid, advice, active = list(r[4]), list(r[5]), list(r[7]), r[11]
        if phase == "post-compact":
            k["shown"] = []
            out.append((session, agent, seq, "silent", 0, 0, 0, False, 0))
            continue
        count = lambda a, b, kept: sum((x in b) == kept for x in a)
        if phase in ("stop", "subagent-stop"):
            if not k["due"] and not k["list"]:
                out.append((session, agent, seq, "silent", 0, 0, 0, False, 0))
                continue
            news = count(advice, k["base"], False) if k["base"] is not None else 0
            row = count(found, k["shown"], False), count(found, k["shown"], True), count(k["list"], found, False)
            same, was = found == k["list"], k["held"]
            k.update(shown=found, list=found, due=False, told=[], base=None if k["base"] is None else advice)
            if not found:
                k.update(held=False, last=[])
                out.append((session, agent, seq, "note" if news else "silent", 0, 0, 0, False, news))
            elif active or (was and same):
                k["held"] = True
                out.append((session, agent, seq, "silent", 0, 0, 0, False, 0))
            else:
                again = not count(found, k["last"], False)
                k.update(held=True, last=found)
                out.append((session, agent, seq, "block", *row, again, news))
            continue
        if phase == "pre-edit" and denied(r):
            out.append((session, agent, seq, "deny", len(invalid), 0, 0, False, 0))
            continue
        if phase == "pre-edit" or r[9]:
            k["due"], k["held"] = True, False
        if k["base"] is None:
            k["base"] = advice
        fresh = [a for a in advice if r[10] and a not in k["base"] and a not in k["told"]]
        k["told"] = k["told"] + fresh
        if phase == "pre-tool":
            if not (k["list"] or r[10] or fresh):
                out.append((session, agent, seq, "silent", 0, 0, 0, False, 0))
                continue
            found = found if r[10] else [x for x in found if x in k["list"]]
        elif invalid and r[8]:
            found = invalid
        row = count(found, k["shown"], False), count(found, k["shown"], True), count(k["list"], found, False)
        k.update(shown=found, list=found)
        out.append((session, agent, seq, "context" if any(row) or fresh else "silent", *row, False, len(fresh)))
    return sorted(out, key=str)


def denied(r):
    return bool(r[5]) and not r[8] and (any(x not in r[6] for x in r[5]) or len(r[5]) > len(r[6]))


def rand(seed, n):
    r = random.Random(seed)
    some = lambda of, k: r.sample(of, r.choice([0, 0, *range(k + 1)]))
    return [event(r.choice("xyz"), r.choice([None, None, "a1", "a2"]), i, r.choice(PHASES), some(list("pqrs"), 3), some(["c1", "c2"], 2), some(["c1", "c2"], 2), some(["v", "w"], 2), r.random() < 0.3, r.random() < 0.4, r.random() < 0.3, r.random() < 0.15) for i in range(n)]


def test_by_hand(spark):
    e = [
        event("s", None, 1, "stop", ["p"]), event("s", None, 2, "pre-edit", ["p", "q"]), event("s", None, 3, "pre-tool", ["p", "z"]), event("s", None, 4, "post-compact"), event("s", None, 5, "pre-tool", ["p"]),
        event("s", None, 6, "stop", ["p"]), event("s", None, 7, "stop", ["p"]), event("s", "a", 8, "pre-tool", changes=True), event("s", None, 9, "stop", ["p"]), event("s", None, 10, "stop", []), event("s", None, 11, "stop", ["p"]),
        event("s", None, 12, "pre-edit", [], ["c"], []), event("s", None, 13, "pre-edit", [], ["c"], [], applied=True), event("s", None, 14, "stop", ["c"], active=True), event("s", None, 15, "stop", [], advice=["v"]),
    ]
    got = {r.seq: (r.kind, r.fresh, r.old, r.resolved, r.repeated, r.advised) for r in S.decisions(spark.createDataFrame(e, S.EVENTS)).collect()}
    assert got == {
        1: ("silent", 0, 0, 0, False, 0), 2: ("context", 2, 0, 0, False, 0), 3: ("context", 0, 1, 1, False, 0), 4: ("silent", 0, 0, 0, False, 0), 5: ("context", 1, 0, 0, False, 0),
        6: ("block", 0, 1, 0, False, 0), 7: ("silent", 0, 0, 0, False, 0), 8: ("silent", 0, 0, 0, False, 0), 9: ("block", 0, 1, 0, True, 0), 10: ("silent", 0, 0, 0, False, 0), 11: ("silent", 0, 0, 0, False, 0),
        12: ("deny", 1, 0, 0, False, 0), 13: ("context", 1, 0, 0, False, 0), 14: ("silent", 0, 0, 0, False, 0), 15: ("note", 0, 0, 0, False, 1),
    }


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_rules_retold(spark, seed):
    e = rand(seed, 400)
    assert rows_of(S.decisions(spark.createDataFrame(e, S.EVENTS).repartition(5))) == told(e)
    assert {r[3] for r in told(e)} == {"silent", "context", "deny", "block", "note"}


def test_nulls(spark):
    e = [(None, None, 1, "stop", None, None, None, None, None, None, None, None), (None, "a", 2, "pre-edit", None, None, None, None, None, None, None, None), (None, None, 3, "stop", ["p"], None, None, None, None, None, None, None)]
    got = {r.seq: r.kind for r in S.decisions(spark.createDataFrame(e, S.EVENTS)).collect()}
    assert got == {1: "silent", 2: "silent", 3: "block"} and S.decisions(spark.createDataFrame([], S.EVENTS)).count() == 0


def test_stream_equals_table(spark, tmp_path):
    e = rand(3, 120)
    for k in range(3):
        spark.createDataFrame(e[k * 40 : k * 40 + 40], S.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = S.stream_decisions(spark.readStream.schema(S.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName("session_stream").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert rows_of(spark.table("session_stream")) == told(e)
