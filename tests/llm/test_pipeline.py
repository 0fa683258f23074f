"""The corpus pipeline, stage by stage against brute-force versions, on a small table with repeated rows."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from concord.llm import op1_mix, op9_quality
from concord.llm.tokens import tokenizer
from tests.llm.test_operators import brute_jaccard, brute_lines, near_docs, rand_texts, words

KIND = "doc_id long, text string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = np.random.default_rng(2)
    junk = [" ".join("".join(r.choice(list("qxzjkv0123456789"), 7)) for _ in range(40)) for _ in range(60)]
    texts = [(i, t) for i, t in near_docs(60)] + [(100 + i, t) for i, t in enumerate(rand_texts(60, 31, 20, 60))] + [(200 + i, t) for i, t in enumerate(junk)]
    texts += [texts[3], texts[3], texts[70], texts[70], (None, texts[5][1]), (None, texts[5][1]), (400, None), (401, ""), (401, ""), (101, texts[75][1] + " and more")]
    rows = [(i, t, f"s{n % 3}", len(t or "")) for n, (i, t) in enumerate(texts)]
    rows += [rows[10], rows[10], rows[90]]
    labels = [(i, int(i < 200), 0) for i, _ in texts[:180]]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def brute_quality(spark, rows, sf_dir):
    scorer = op9_quality.Scorer(op9_quality.fit(*op9_quality.training_rows(spark.createDataFrame(rows, KIND), spark.read.parquet(f"{sf_dir}/labels.parquet"))))
    return [r for r in rows if scorer.score(r[1]) >= op9_quality.THRESHOLD]


def brute_rest(rows):
    gone, out = brute_lines([(i, t) for i, t, *_ in rows]), []
    for i, t, source, n in rows:
        dropped = gone.get(i, []) if i is not None else []
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dropped)
        if not dropped or words(left):
            out.append((i, left, source, None if left is None else len(left)))
    return out


def brute_one(rows):
    part = brute_jaccard([(i, t) for i, t, *_ in rows], 5, 80)
    return {i for i, *_ in rows if i is not None and part[i][1] == i}


def test_stages(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixture", "packing"]
    run = {name: lambda rows, f=f: [tuple(r) for r in f(spark, spark.createDataFrame(rows, KIND).repartition(3), sf_dir).collect()] for name, f in corpus_pipeline.STAGES}
    start = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]

    good = run["quality"](start)
    assert Counter(good) == Counter(brute_quality(spark, start, sf_dir)) and 40 < len(good) < len(start) - 40

    # a repeated id takes the lines of all its rows here, so its differing row is looked at in the next stage
    distinct = {i for i, n in Counter(i for i, _ in {(r[0], r[1]) for r in good}).items() if n == 1 or i is None}
    good = [r for r in good if r[0] in distinct]
    rest = run["lines"](good)
    assert Counter(rest) == Counter(brute_rest(good)) and len(rest) < len(good)

    again = [*rest, *[r for r in start if r[0] in (101, 401)], (7001, None, "s1", None), (7001, None, "s1", None)]
    one = run["near_duplicates"](again)
    ids = Counter(r[0] for r in one)
    assert max(n for i, n in ids.items() if i is not None) == 1  # repeated ids come once
    assert set(ids) - {None} == brute_one(again) and ids[None] == sum(r[0] is None for r in again) and set(one) <= set(again)
    assert next(r for r in one if r[0] == 101)[1] == min(r[1] for r in again if r[0] == 101)

    mixed = run["mixture"](one)
    often = Counter()
    for r in op1_mix.mix_report(spark.createDataFrame(one, KIND)).collect():
        often[r.doc_id, r.source] += r.repeats
    assert Counter((r[0], r[2]) for r in mixed) == +often and set(mixed) <= set(one)

    pieces = run["packing"](mixed)
    tok = tokenizer("byte_bpe_50k.json")
    want = Counter()
    for i, t, *_ in mixed:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    have = Counter()
    for i, _, length, *_ in pieces:
        have[i] += length
    assert have == want


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    size = lambda df: Counter({(r[0], r[1]): r[2] for r in df.groupBy("doc_id", "start").sum("length").collect()})
    assert size(corpus_pipeline.run(spark, sf_dir)) == size(docs) and docs.count()
