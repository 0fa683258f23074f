"""op12: the solver against every sequence of edits, the rows against a plain replay, on ties, nulls and long conversations."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from concord.llm import op12_repair as op

ROWS = "conv_id long, turn long, role string, text string, cost int, digest string, n int"  # the last three clash with inner names
LEGAL = re.compile(r"(s?(ua)+)?")
WS = " \t\n\x0b\x0c\r"


def options(code, state_free=True):
    out = [("D", 2, "")]
    if code.lower() != "d":
        late = 5 if code.isupper() else 0
        out.append(("K", late, code.lower()))
        out += [("R", 1 + late, r) for r in "ua"]
    return out


def exhaustive(signature):
    """Over all edits with at most two rows put in at each place."""
    puts = ["", "u", "a", "ua", "au", "uu", "aa"]
    best = None
    for between in itertools.product(puts, repeat=len(signature) + 1):
        if sum(map(len, between)) > 4:
            continue
        for edits in itertools.product(*map(options, signature)):
            roles = between[0] + "".join(e[2] + b for e, b in zip(edits, between[1:], strict=True))
            if LEGAL.fullmatch(roles):
                audit = "I" * len(between[0]) + "".join(e[0] + "I" * len(b) for e, b in zip(edits, between[1:], strict=True))
                cost = sum(e[1] for e in edits) + 5 * sum(map(len, between))
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_solver_against_all_edits():
    r = np.random.default_rng(1)
    seen = {"", "s", "u", "a", "d", "A", "U"} | {"".join(r.choice(list("ssuuaaUAxXdS"), n)) for n in (2, 3, 4) for _ in range(25)}
    for s in sorted(seen):
        assert op.solve(s) == exhaustive(s), s


def test_long_signature():
    cost, audit = op.solve("s" + "ua" * 30_000 + "uD" + "ua" * 10)
    assert cost == 0 + 2 + 2 and len(audit) == 60_023


def plain(rows, conversations):
    out = {}
    for c in conversations:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, (r[2]).encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        code, counts, seen = "", [0, 0, 0], set()
        for _, _, role, text in own:
            if not text.strip(WS):
                counts[0] += 1
                code += "d"
            elif (role, text) in seen:
                counts[1] += 1
                code += "d"
            else:
                late = text.rstrip(WS)[-1] not in ".!?"
                counts[2] += late
                x = role[:1] if role[:1] in ("s", "u", "a") else "x"
                code += x.upper() if late else x
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = op.solve(code)
        left, fixed = iter(own), []
        for e in audit:
            row = None if e == "I" else next(left)
            if e != "D":
                role = row[2] if e == "K" else "assistant" if fixed and fixed[-1][0].startswith("u") else "user"
                fixed.append((role, row[3] if row else "", e))
        assert LEGAL.fullmatch("".join(r[0] for r, _, _ in fixed))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in fixed).encode()).hexdigest()
        out[c] = ((gaps, *counts, illegal, cost, audit, digest), [(c, i, *x) for i, x in enumerate(fixed)])
    return out


def damaged(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    out = []
    for c in [*range(40), None]:
        for turn in range(int(r.integers(1, 9))):
            text = [None, "", " \t", "Yes.", "No", "What? ", "é!\n", "x. y", "Long " * 50 + "."][r.integers(9)]
            role = ["user", "assistant", "user", "assistant", "system", "tool", "", None][r.integers(8)]
            turn = [turn, None, turn * 7][r.choice(3, p=[0.8, 0.1, 0.1])]
            out += [(c, turn, role, text)] * int(r.choice([1, 1, 1, 3]))
    out += [(500, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(3000)]
    out += [(501, 5, "user", "Same.")] * 400 + [(502, 1, "u", "Ab."), (502, 2, "a", "Cd.")]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], ROWS).repartition(4)


def test_audits(spark, rows):
    t = table(spark, rows)
    got = op.audits(op.damage(t), t).collect()
    want = plain(damaged(rows), {r[0] for r in rows})
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: x[0] for c, x in want.items()} and len(got) == len(want)


def test_repaired(spark, rows):
    keep = [tuple(" " if x is None and k > 1 else x for k, x in enumerate(r)) for r in rows]
    got = sorted(map(tuple, op.repaired(table(spark, rows)).collect()), key=repr)
    assert got == sorted((r for _, fixed in plain(keep, {r[0] for r in rows}).values() for r in fixed), key=repr)


def test_none(spark):
    none = spark.createDataFrame([], ROWS)
    assert op.audits(op.damage(none), none).collect() == [] and op.repaired(none).collect() == []
    ids = spark.createDataFrame([(7,), (7,), (None,)], "conv_id long")
    got = {tuple(r) for r in op.audits(none, ids).collect()}
    assert got == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (7, None)}
