"""op11 against a brute-force version, on rows that repeat, lack ids or texts, and hold long words."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from concord.llm import op11_resample as op
from tests.llm.test_operators import rand_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, weight string, score int, part int"  # the last three clash with inner names


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, percent):
    known = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in known for b in f), Counter(b for x in target for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in known:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 9) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    texts = rand_texts(150, seed=4, lo=0, hi=80)
    out = list(enumerate(texts))
    out += [(200, None), (201, ""), (202, " .,!\n"), (203, "One"), (204, "A b"), (None, texts[3] * 3), (None, None)]
    out += [(300 + i, texts[7] + " more words " * 10) for i in range(30)]  # copies under other ids
    out += [(400, texts[8] + " x" * 30)] * 40  # one row many times
    out += [(401, "é" * 200 + " " + "z" * 700 + " b " * 25 + "w" * 64 + " " + "v" * 65), (402, " ".join(texts) * 3)]
    return out


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_resample(spark, rows, percent):
    target = [t for _, t in rows[:9]] + [None, ""]
    got = op.resample(table(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target, percent)


def test_windows_carry_two_words(rows, monkeypatch):
    monkeypatch.setattr(op, "_WINDOW", 37)
    texts = [t for _, t in rows if len(t or "") < 3000]
    got = [[] for _ in texts]
    for doc, runs in op.features(texts):
        for r in runs:
            for i, b in zip(doc.tolist(), r.tolist(), strict=True):
                got[i] += [b] * (b >= 0)
    assert [sorted(x) for x in got] == [sorted(features(t)[1]) for t in texts]


def test_cutoff_splits_ranges(spark):
    values = [-(10**12), 5, 5, 5, 6, 10**12, 10**12 + 1, 7]
    scores = spark.createDataFrame([(v,) for v in values], "score long")
    assert [op.cutoff(scores, k) for k in range(1, 9)] == sorted(values, reverse=True)


def test_none_and_few(spark, rows):
    none = spark.createDataFrame([], DOCS)
    assert op.resample(none, none).collect() == []
    few = op.resample(table(spark, rows[:12]), none).collect()
    assert len(few) == 12 and all(r.rank is None for r in few)


def test_reruns_agree(spark, rows):
    t = table(spark, rows)
    a, b = (sorted(map(tuple, x.collect()), key=repr) for x in (op.resample(t, t), op.resample(t.repartition(7), t)))
    assert a == b
