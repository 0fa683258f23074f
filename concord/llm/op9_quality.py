"""Quality by compression: two Zstandard dictionaries, one of good text and one of bad.

A text is cut into blocks of a fixed size and each block compressed with either dictionary;
the difference of the two sums over their total, calibrated on labelled texts that neither
dictionary has seen, is the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.batches import slices, small_batches, tidy

#: Bytes of a block, of a dictionary, and the compression level.
BLOCK, DICT_BYTES, LEVEL = 2048, 128 << 10, 3
#: Bounds of the labelled sample: rows of each label, and characters of all its texts.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 24_000_000
#: Share of the sample that the dictionaries are trained on; the rest calibrates.
TRAIN_SHARE = 0.6
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """good, bad: dictionaries. xs, ps: knots of the calibration, both ascending."""

    good: bytes
    bad: bytes
    xs: tuple[float, ...]
    ps: tuple[float, ...]


class Scorer:
    def __init__(self, model: Model) -> None:
        def packer(data: bytes) -> zstd.ZstdCompressor:
            if not data:
                return zstd.ZstdCompressor(level=LEVEL, write_content_size=False)
            known = zstd.ZstdCompressionDict(data)
            known.precompute_compress(level=LEVEL)
            return zstd.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)

        self.good, self.bad, self.xs, self.ps = packer(model.good), packer(model.bad), np.array(model.xs), np.array(model.ps)

    def difference(self, text: str | None) -> float:
        data, g, b = (text or "").encode(), 0, 0
        for i in range(0, len(data), BLOCK):
            block = data[i : i + BLOCK]
            g += len(self.good.compress(block))
            b += len(self.bad.compress(block))
        return (b - g) / (b + g) if b + g else 0.0

    def score(self, text: str | None) -> float:
        return float(np.interp(self.difference(text), self.xs, self.ps)) if len(self.xs) else 0.5


def _blocks(texts: list[str]) -> list[bytes]:
    return [d[i : i + BLOCK] for d in (t.encode() for t in texts) for i in range(0, len(d), BLOCK)]


def _dictionary(texts: list[str]) -> bytes:
    blocks = _blocks(texts)
    try:
        return zstd.train_dictionary(DICT_BYTES, blocks, k=200, d=8).as_bytes()
    except (zstd.ZstdError, ValueError):  # too little text to train on
        return b"".join(blocks)[:DICT_BYTES]


def calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Monotone calibration: pooled adjacent violators on quantile bins of rows with weights w, smoothed towards a half."""
    if not len(x):
        return (), ()
    order = np.argsort(x, kind="stable")
    bins = np.array_split(order, max(1, min(60, len(x) // 15)))
    pools: list[list[float]] = []
    for b in bins:
        pools.append([float((w * y)[b].sum()), float(w[b].sum()), float((w * x)[b].sum())])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            top = pools.pop()
            pools[-1] = [a + c for a, c in zip(pools[-1], top, strict=True)]
    xs = [s / n for _, n, s in pools]
    ps = [(k + 0.5) / (n + 1) for k, n, _ in pools]
    return tuple(xs), tuple(float(p) for p in np.maximum.accumulate(ps))


def fit(rows: list[tuple[str, int]], in_all: dict[int, int]) -> Model:
    """rows: (text, label) in a fixed order; each label's first share trains, its rest calibrates.

    in_all: eligible documents of each label, sampled or not. Calibration rows stand for
    them, so that the prior is that of all labelled documents whatever the sample's is.
    """
    train: dict[int, list[str]] = {0: [], 1: []}
    rest: list[tuple[str, int]] = []
    sampled = Counter(q for _, q in rows)
    # 1 for every row where nothing was left out; the weights of a sample add up to about its rows
    weight = {label: n * sum(sampled.values()) / (sampled[label] * sum(in_all.values())) for label, n in in_all.items() if sampled[label]}
    for label in (0, 1):
        own = [t for t, q in rows if q == label]
        n = math.ceil(len(own) * TRAIN_SHARE)
        train[label] = own[:n]
        rest += [(t, label) for t in own[n:]]
    model = Model(_dictionary(train[1]), _dictionary(train[0]), (), ())
    s = Scorer(model)
    xs, ps = calibrate(np.array([s.difference(t) for t, _ in rest]), np.array([q for _, q in rest], dtype=float), np.array([weight[q] for _, q in rest]))
    return Model(model.good, model.bad, xs, ps)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """The bounded sample, and the documents of each label that it is drawn from.

    The sample: of each label the SAMPLE_ROWS documents first by hash, whole texts, held-out
    rows left out; one whose text is longer than what SAMPLE_CHARS has left is passed over.
    Of the rows of one id the first text in order counts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("int").alias("quality"))
    fit = ~held_out() & F.col("text").isNotNull() & (F.col("text") != "")
    pool = docs.where(fit).select("doc_id", F.length("text").alias("size")).join(known, F.col("doc_id") == F.col("id"))
    pool = pool.groupBy("doc_id", "quality").agg(F.max("size").alias("size"))
    in_all = {r.quality: r["count"] for r in pool.groupBy("quality").count().collect()}
    # the ids are chosen first, so that texts are read for the sample alone
    chosen: dict[int, int] = {}
    for label in (0, 1):
        room = SAMPLE_CHARS
        for r in pool.where(F.col("quality") == label).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(SAMPLE_ROWS).collect():
            if r.size <= room:
                chosen[r.doc_id], room = label, room - r.size
    if not chosen:
        return [], {}
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "id long")  # at most two SAMPLE_ROWS rows
    rows = docs.where(fit).select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    found = rows.groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.xxhash64(F.lit(3), "doc_id").alias("h")).collect()
    return [(r.text, chosen[r.doc_id]) for r in sorted(found, key=lambda r: (r.h, r.doc_id))], in_all


def _apply(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            scores = [scorer.score(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*b.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score. A map without shuffle; null text scores as empty text."""
    return docs.select("doc_id", "text").mapInArrow(tidy(_apply(model)), "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null and empty texts score as a difference of 0. Without labelled rows every score is
    0.5. Null doc_ids are not held out. Repeated rows are repeated; a doc_id labelled more
    than once takes its highest label. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    model = fit(*training_rows(docs, labels))
    scored = score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the threshold, all columns kept; every document where no labelled rows are left to calibrate on."""
    small_batches(docs.sparkSession)
    model, docs_columns = fit(*training_rows(docs, labels)), docs.columns
    if not model.xs:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        at = docs_columns.index("text")
        for b in (x for whole in batches for x in slices(whole, column=at)):
            yield b.filter(pa.array([scorer.score(t) >= THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
