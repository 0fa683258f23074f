"""op13 against a brute-force version, on passages in several places, copies, edits, periodic texts and rows without ids."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import op13_repeats as op
from tests.llm.test_operators import rand_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, t string, h int, spans int"  # the last three clash with inner names


def brute(rows, length):
    windows = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        if i is not None:
            for p in range(len(w) - length + 1):
                key = tuple(w[p : p + length])
                windows[key] = min(windows.get(key, i), i)
    out = []
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        if i is not None:
            for p in range(len(w) - length + 1):
                if windows[tuple(w[p : p + length])] < i:
                    gone.update(range(p, p + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=repr)


def mixed(seed):
    r = np.random.default_rng(seed)
    base = rand_texts(12, seed=seed, lo=150, hi=300)
    passage = [" ".join(r.choice([f"p{i}" for i in range(500)], n)) for n in (49, 50, 51, 70, 160)]
    rows = []
    for i in range(60):
        w = base[r.integers(12)].split(" ")
        for _ in range(r.integers(0, 4)):  # edits
            w[r.integers(len(w))] = f"edit{r.integers(9)}"
        a = r.integers(0, len(w))
        text = " ".join(w[a : a + int(r.integers(20, 250))])
        for p in r.choice(passage, r.integers(0, 3)):
            text = f"{text} {p}\n {' '.join(r.choice(['x', 'y', 'zz'], r.integers(0, 30)))}" if r.random() < 0.5 else f"{p}\t{text}"
        rows.append((int(r.integers(0, 50)), text))  # ids repeat
    rows += [(100, "a " * 300), (101, "a " * 120 + "b " + "a " * 60), (99, "a " * 55), (102, "a b c " * 90), (103, "c a b " * 70), (104, "b a " + "a b c " * 40)]
    rows += [(7000 + i, base[0]) for i in range(20)] + [(8000, base[1])] * 15 + [(None, base[1])] * 3
    rows += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "one"), (9004, "é " * 30 + passage[4] + " ü" * 10), (None, None)]
    order = r.permutation(len(rows))
    return [rows[i] for i in order]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS).repartition(4)


def check(got, rows, length):
    rows_got = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows_got), key=repr) == brute(rows, length)
    for r in rows_got:
        spans = [(s.start, s.stop) for s in r.removed]
        assert sum(b - a for a, b in spans) == r.n_removed and all(b - a >= length for a, b in spans)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize(("seed", "length"), [(1, 50), (2, 50), (3, 16), (4, 23)])
def test_passages(spark, seed, length):
    rows = mixed(seed)
    check(op.without_passages(table(spark, rows), length), rows, length)


def test_blocks(spark, monkeypatch):
    """A text of more windows than a block gives the same anchors, some of them in two parts."""
    rows = mixed(5)
    w, starts, _ = op.words("\n".join(t or "" for _, t in rows), lower=False)
    doc = np.searchsorted(np.cumsum([len((t or "").encode()) + 1 for _, t in rows]), starts, side="right")
    whole = np.concatenate([np.stack(x[:3]) for x in op.anchors(w, doc)], axis=1)
    monkeypatch.setattr(op, "_BLOCK", 77)
    parts = np.concatenate([np.stack(x[:3]) for x in op.anchors(w, doc)], axis=1)
    spread = lambda m: sorted((p, a) for a, first, last in m.T.tolist() for p in range(first, last + 1))
    assert spread(whole) == spread(parts) and len(parts.T) > len(whole.T)
    valid = [p for p in range(len(doc) - 49) if doc[p] == doc[p + 49]]
    assert [p for p, _ in spread(whole)] == valid and all(p <= a <= p + 50 - op.GRAM for p, a in spread(whole))


def test_long_and_none(spark):
    r = np.random.default_rng(0)
    long = " ".join(r.choice([f"v{i}" for i in range(5000)], 400_000))
    w = long.split(" ")
    rows = [(1, " ".join(w[1000:1100])), (2, long), (3, " ".join([*w[:200_000], "new", *w[200_000:]]))]
    got = {x.doc_id: x for x in op.without_passages(table(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 100 and [tuple(s) for s in got[2].removed] == [(1000, 1100)]
    assert got[3].kept == "new" and got[3].n_removed == 400_000
    assert op.without_passages(table(spark, []).limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op.op13_repeats(spark, sf)
    want = [(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute(rows, 50)]
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert got.agg(F.sum("n_removed")).first()[0] > 0
