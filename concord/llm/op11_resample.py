"""Importance resampling towards a target: documents drawn by hashed n-gram features and Gumbel noise.

Both corpora are counted into BUCKETS buckets; a bucket's gain is the log ratio of its smoothed
shares, in thousandths. A document's weight is the sum of its features' gains, looked up in one
array; weight plus noise is its score, an integer. The cutoff among the scores is found by a
histogram of SPAN equal ranges whose boundary range is split again until it holds one score;
the scores that reach it are counted, their counts summed from the highest down to rank
offsets, and rows are numbered by doc_id within each score alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.batches import slices, small_batches, tidy
from concord.plans.shared import cut, free, scratch

BUCKETS = 10_000
#: Documents of fewer words are not drawn; of the others, PERCENT in a hundred are.
MIN_WORDS, PERCENT = 20, 5
SEED = 42
#: Ranges of a histogram of scores: what the driver gathers at once.
SPAN = 4096
#: Bytes of text whose words are worked on at a time.
_WINDOW = 1 << 21

_WORD = np.ones(256, dtype=bool)
_WORD[[b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)]] = False
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()
_FULL = np.uint32(0xFFFFFFFF)
#: Words of more bytes are hashed one by one, and passed over by steps of powers of two.
_SHORT = 64


def _after(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Apply a linear map of 32 bits, given as four tables of a byte each."""
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


def _zeros(most: int) -> np.ndarray:
    """[n, j, byte]: what n zero bytes make of a CRC's byte j, for n up to most."""
    out = np.empty((most + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(1, most + 1):
        out[n] = _CRC[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


_ZEROS = _zeros(_SHORT)
_FLAT = _ZEROS.reshape(-1)


def _append(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRCs c after n zero bytes each; with the next word's own CRC xored in, the CRC of both."""
    at = np.minimum(n, _SHORT) << 10
    out = _FLAT[at + (c & 255)] ^ _FLAT[at + 256 + ((c >> 8) & 255)] ^ _FLAT[at + 512 + ((c >> 16) & 255)] ^ _FLAT[at + 768 + (c >> 24)]
    long = np.flatnonzero(n > _SHORT)
    if len(long):
        left, table, x = n[long] - _SHORT, _ZEROS[1], out[long]
        while left.any():
            odd = (left & 1).astype(bool)
            x[odd] = _after(table, x[odd])
            left, table = left >> 1, _after(table, table)
        out[long] = x
    return out


def _crc_words(data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    c = np.full(len(starts), _FULL, dtype=np.uint32)
    live = np.flatnonzero(n <= _SHORT)
    for j in range(_SHORT):
        live = live[n[live] > j] if j else live
        if not len(live):
            break
        was = c[live]
        c[live] = _CRC[(was ^ data[starts[live] + j]) & 255] ^ (was >> 8)
    for i in np.flatnonzero(n > _SHORT).tolist():
        c[i] = zlib.crc32(data[starts[i] : starts[i] + n[i]]) ^ 0xFFFFFFFF
    return c ^ _FULL


def _space(c: np.ndarray) -> np.ndarray:
    """The CRCs after one space more."""
    raw = c ^ _FULL
    return (_CRC[(raw ^ 32) & 255] ^ (raw >> 8)) ^ _FULL


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(each word's text, the buckets of the one, two and three words that end in it; -1 where the text has no such run).

    The words of all texts in their order, window by window: two words are carried over, so
    a text of any length needs memory for a window or for its longest word.
    """
    coded = [(t or "").encode() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in coded])
    raw = b"\n".join(coded).translate(_LOWER)
    whole = np.frombuffer(raw, dtype=np.uint8)
    doc, crc, size, at = np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int64), 0
    while at < len(raw):
        to = min(len(raw), at + _WINDOW)
        while to < len(raw):  # on to the end of the word
            stop = np.flatnonzero(~_WORD[whole[to : to + _WINDOW]])
            if len(stop):
                to += int(stop[0])
                break
            to = min(len(raw), to + _WINDOW)
        inside = np.zeros(to - at + 2, dtype=bool)
        inside[1:-1] = _WORD[whole[at:to]]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, n = edge[::2], edge[1::2] - edge[::2]
        old = len(doc)
        doc = np.concatenate((doc, np.searchsorted(ends, starts + at, side="right")))
        crc = np.concatenate((crc, _crc_words(whole[at:to], starts, n)))
        size = np.concatenate((size, n))
        runs, last = [crc.astype(np.int64) % BUCKETS], crc
        for k in (1, 2):
            joined = _append(_space(last[:-1]), size[k:]) ^ crc[k:] if len(last) > 1 else last[:0]
            run = np.full(len(crc), -1, dtype=np.int64)
            run[k:] = np.where(doc[k:] == doc[:-k], joined.astype(np.int64) % BUCKETS, -1)
            runs.append(run)
            last = joined
        if len(starts):
            yield doc[old:], [r[old:] for r in runs]
        doc, crc, size, at = doc[-2:], crc[-2:], size[-2:], to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for part in (x for batch in batches for x in slices(batch, column=0)):
        for _, runs in features(part.column(0).to_pylist()):
            for r in runs:
                total += np.bincount(r[r >= 0], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): the features of all texts by bucket, at most BUCKETS rows; each task sends at most so many."""
    small_batches(texts.sparkSession)
    return texts.select(text_col).mapInArrow(tidy(_count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text") -> np.ndarray:
    """The gain of each bucket; an empty table counts as one without features."""
    counts = []
    for texts in (docs, target):
        own = [0] * BUCKETS
        for r in bucket_counts(texts, text_col).collect():  # BUCKETS rows at most
            own[r.bucket] = r.n
        counts.append(own)
    (s, t), (all_s, all_t) = counts, map(sum, counts)
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + BUCKETS) / ((a + 1) * (all_t + BUCKETS)))) for a, b in zip(s, t, strict=True)], dtype=np.int64)


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = np.append(gain, 0)  # at -1: no such run
        for part in (x for batch in batches for x in slices(batch)):
            weight, words, n = (np.zeros(part.num_rows, dtype=np.int64) for _ in range(3))
            for doc, runs in features(part.column(1).to_pylist()):
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                at = doc[first]
                weight[at] += np.add.reduceat(sum(more[r] for r in runs), first)
                words[at] += np.add.reduceat(np.ones(len(doc), dtype=np.int64), first)
                n[at] += np.add.reduceat(sum((r >= 0).astype(np.int64) for r in runs), first)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, fixed by seed and doc_id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def cutoff(scores: DataFrame, k: int) -> int:
    """The k-th highest of scores(score); k from 1 to the number of rows. Gathers SPAN counts a round, of one range after another."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        width = (high - low) // SPAN + 1
        inside = scores.where(F.col("score").between(low, high)).groupBy(F.expr(f"(score - {low}L) div {width}L").alias("part")).count()
        for part, n in sorted(((r.part, r["count"]) for r in inside.collect()), reverse=True):
            if k <= n:
                low, high = low + part * width, min(high, low + (part + 1) * width - 1)
                break
            k -= n
    return low


def _offsets(counts: DataFrame) -> DataFrame:
    """counts(score, n), a row a score -> (score, above): the rows of all higher scores.

    Sums from the highest down over ranges of scores: within a range by a window, before it
    by the ranges' totals, of which there are as many as shuffle partitions.
    """
    ranged = cut(counts.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()), "resample-ranges")
    totals = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before = np.concatenate(([0], np.cumsum([n for _, n in totals], dtype=np.int64))).tolist()
    starts = counts.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(totals, before, strict=False)], "at int, before long")
    inside = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("above", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return summed.join(F.broadcast(starts), F.col("part") == F.col("at")).select("score", (F.col("above") + F.col("before")).alias("above"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of docs(doc_id, text): doc_id, n_words, n_features, weight, score, rank (null if not drawn).

    Null and empty texts have no features and weight 0. Ties in score go to the smaller
    doc_id, null ids last; rows that repeat an id and its text have ranks of their own, next
    to each other, and rows of one id with other texts go by weight, then by number of
    features. Nothing is drawn where percent of the rows of min_words and more is below one
    row, or docs is empty; an empty target weighs by rarity alone. Other columns, whatever
    their names, are not read. Texts are read twice, to count and to weigh, and never shuffled.
    """
    small_batches(docs.sparkSession)
    names = ("doc_id", "n_words", "n_features", "weight", "score")
    with scratch() as made:
        gain = gains(docs, target)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_weigh(gain)), "doc_id long, n_words long, n_features long, weight long")
        rows = made.keep(cut(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores"))
        able = rows.where(F.col("n_words") >= min_words)
        k = percent * able.count() // 100
        if not k:
            return rows.withColumn("rank", F.lit(None).cast("long"))
        least = cutoff(able.select("score"), k)
        high = (F.col("n_words") >= min_words) & (F.col("score") >= least)
        # rows that repeat count down before they are numbered
        drawn = rows.where(high).groupBy(*names).agg(F.count("*").alias("n"))
        offsets = _offsets(rows.where(high).groupBy("score").agg(F.count("*").alias("n")))
        order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features", "n_words").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = drawn.withColumn("upto", F.sum("n").over(order)).join(offsets, "score")
        last = F.col("above") + F.col("upto")
        ranked = ranked.select(*names, F.explode(F.sequence(last - F.col("n") + 1, last)).alias("rank"))
        ranked = made.keep(cut(ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))), "resample-ranks"))
        return rows.where(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
