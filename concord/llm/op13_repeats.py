"""Removal of passages that stand in an earlier document: seed and extend.

Seeds are winnowed runs of GRAM words: of the runs inside any window of `length` words the one
of least hash, the first of these, is the window's anchor, so equal windows have equal anchors
wherever they stand. Occurrences of an anchor meet its first one, in the least document that
has it. Where the words of all windows of that anchor are the same there, all of them repeat;
else the two are compared word by word, both ways from the anchor, and the windows inside the
longest common run repeat. A window that differs from the first occurrence's may still stand in
another document that does too: those few meet by a 128-bit hash. So a group of any number of
copies costs one comparison for each anchor of each copy and never a pair of copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.batches import slices, small_batches, tidy
from concord.llm.words import mix64, words
from concord.plans.shared import cut, free, scratch

#: Words of a passage that is removed where it repeats.
LENGTH = 50
#: Words of a seed: 2 to this power. Shorter seeds are fewer, but stand in more places by chance.
GRAM_LOG = 4
GRAM = 1 << GRAM_LOG
#: Windows that are worked on at a time.
_BLOCK = 1 << 19
_BASE = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[ \t-\r]+")

ANCHORS = "doc_id long, t long, h long, at int, most short, least short, span long"


def grams(w: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM words."""
    for k in range(GRAM_LOG):
        step = 1 << k
        w = mix64(w[:-step] * _BASE + w[step:] + np.uint64(k)) if len(w) > step else w[:0]
    return w


def first_least(g: np.ndarray, width: int) -> np.ndarray:
    """For each place with width values from it on: where their least is, the first of equals."""
    n = len(g) - width + 1
    at, done = np.arange(len(g)), 1
    while done < width:
        step = min(done, width - done)
        a, b = at[: len(at) - step], at[step:]
        at, done = np.where(g[b] < g[a], b, a), done + step
    return at[: max(n, 0)]


def anchors(w: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, first and last window that it is the anchor of, its hash, the hash of all words of these windows), places in w; block by block.

    w, doc: the hash and the document of each word; windows lie in one document. An anchor
    whose windows a block parts comes in two parts.
    """
    for b in range(0, len(w) - length + 1, _BLOCK):
        own = w[b : b + _BLOCK + length - 1]
        g = grams(own)
        at = first_least(g, length - GRAM + 1)
        inside = doc[b : b + len(at)] == doc[b + length - 1 : b + length - 1 + len(at)]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
        last = inside.copy()
        last[:-1] &= ~inside[1:] | (at[1:] != at[:-1])
        first, last = np.flatnonzero(new), np.flatnonzero(last)
        raw = memoryview(np.ascontiguousarray(own)).cast("B")
        spans = np.array([xxhash.xxh3_64_intdigest(raw[8 * p : 8 * (q + length)]) for p, q in zip(first.tolist(), last.tolist(), strict=True)], dtype=np.uint64)
        yield at[first] + b, first + b, last + b, g[at[first]], spans


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, column=2)):
            texts = [x or "" for x in part.column(2).to_pylist()]
            ends = np.cumsum([len(x.encode()) + 1 for x in texts])
            w, starts, _ = words("\n".join(texts), lower=False)
            doc = np.searchsorted(ends, starts, side="right")
            zero = np.searchsorted(doc, np.arange(len(texts)))  # a text's first word
            for at, first, last, h, span in anchors(w, doc, length):
                row = doc[first]
                ids = [part.column(c).take(pa.array(row)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(h.view(np.int64)), pa.array(at - zero[row], pa.int32()), pa.array(at - first, pa.int16()), pa.array(at - last, pa.int16()), pa.array(span.view(np.int64))], [x.split()[0] for x in ANCHORS.split(", ")])

    return run


def bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends."""
    space = np.ones(len(raw) + 2, dtype=bool)
    space[1:-1] = _SPACE[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


CONTEXTS = "doc_id long, t long, at int, before int, around string"


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = length - GRAM
        for part in (x for batch in batches for x in slices(batch, column=2)):
            for doc_id, t, text, at in zip(*(c.to_pylist() for c in part.columns), strict=True):
                raw = (text or "").encode()
                starts, ends = bounds(raw)
                for k in range(0, len(at), 4096):
                    rows = [(doc_id, t, i, min(i, side), _GAP.sub(b" ", raw[starts[max(0, i - side)] : ends[min(len(ends), i + length) - 1]]).decode()) for i in at[k : k + 4096]]
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in CONTEXTS.split(", ")])

    return run


def extend(own: list[bytes], i: int, other: list[bytes], j: int) -> tuple[int, int]:
    """Equal words before the anchors at i and j, and from the anchors' starts on; -1, -1 where the anchors differ."""
    if own[i : i + GRAM] != other[j : j + GRAM]:
        return -1, -1
    left = next((k for k in range(min(i, j)) if own[i - 1 - k] != other[j - 1 - k]), min(i, j))
    right = next((k for k in range(GRAM, min(len(own) - i, len(other) - j)) if own[i + k] != other[j + k]), min(len(own) - i, len(other) - j))
    return left, right


EXTENDED = "doc_id long, t long, start int, stop int, places array<int>, x array<long>, y array<long>"


def _extend(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            out = []
            for doc_id, t, at, most, least, later, i, around, j, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = around.encode()
                own = raw.split(b" ")
                left, right = extend(own, i, first.encode().split(b" "), j)
                # windows by how many words they begin before the anchor
                low, high = max(least, length - right), min(most, left)
                found = [o for o in range(least, most + 1) if not low <= o <= high]
                starts = np.cumsum([0, *(len(x) + 1 for x in own)]).tolist()
                digests = [xxhash.xxh3_128_digest(raw[starts[i - o] : starts[i - o + length] - 1]) for o in found]
                h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                start, stop = (at - high, at - low + length) if later and low <= high else (None, None)
                out.append((doc_id, t, start, stop, [at - o for o in found], h[:, 0], h[:, 1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in EXTENDED.split(", ")])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, t, spans): of each row with some, the runs of words [start, stop) of windows that also start in a smaller doc_id.

    docs(doc_id, text, t), t the hash of the text: a row is known by doc_id and t. Spans of
    a row may touch and overlap. Needs length of at least GRAM.
    """
    if length < GRAM:
        raise ValueError(f"passages have at least {GRAM} words")
    small_batches(docs.sparkSession)
    at = ["doc_id", "t", "at"]
    with scratch() as made:
        docs = docs.where("doc_id is not null").select("doc_id", "t", "text")
        found = cut(docs.mapInArrow(tidy(_anchors(length)), ANCHORS), "repeats-anchors")
        first = F.min(F.struct(*at, "most", "least", "span")).alias("first")
        firsts = cut(found.groupBy("h").agg(first, F.max("doc_id").alias("last")).where("first.doc_id < last").select("h", "first"), "repeats-first")
        seeds = found.join(firsts, "h").where(F.struct(*at) != F.struct(*(f"first.{c}" for c in at)))
        same = F.struct("most", "least", "span") == F.struct("first.most", "first.least", "first.span")
        seeds = cut(seeds.withColumn("same", same).where("not same or doc_id > first.doc_id").drop("h", "span"), "repeats-seeds")
        free(found, firsts)
        whole = seeds.where("same").select("doc_id", "t", (F.col("at") - F.col("most")).alias("start"), (F.col("at") - F.col("least") + length).alias("stop"))
        part = seeds.where("not same")
        wanted = part.select(*at).unionByName(part.select(*(F.col(f"first.{c}").alias(c) for c in at))).distinct()
        wanted = cut(wanted.groupBy(F.col("doc_id").alias("id"), F.col("t").alias("of")).agg(F.collect_list("at").alias("at")), "repeats-wanted")
        texts = docs.join(wanted, (F.col("doc_id") == F.col("id")) & (F.col("t") == F.col("of"))).select("doc_id", "t", "text", "at")
        around = cut(texts.mapInArrow(tidy(_contexts(length)), CONTEXTS).dropDuplicates(at), "repeats-around")
        mine = part.join(around, at).select(*at, "most", "least", (F.col("doc_id") > F.col("first.doc_id")).alias("later"), F.col("before").alias("i"), F.col("around").alias("own"), *(F.col(f"first.{c}").alias(f"first_{c}") for c in at))
        theirs = around.select(*(F.col(c).alias(f"first_{c}") for c in at), F.col("before").alias("j"), F.col("around").alias("other"))
        pairs = mine.join(theirs, [f"first_{c}" for c in at]).select(*at, "most", "least", "later", "i", "own", "j", "other")
        extended = cut(pairs.mapInArrow(tidy(_extend(length)), EXTENDED), "repeats-extended")
        free(wanted, around)
        rest = extended.select("doc_id", "t", F.explode(F.arrays_zip("places", "x", "y")).alias("w")).select("doc_id", "t", F.col("w.places").alias("start"), "w.x", "w.y")
        owners = cut(rest.groupBy("x", "y").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last"), "repeats-owners")
        others = rest.join(owners, ["x", "y"]).where("doc_id > owner").select("doc_id", "t", "start", (F.col("start") + length).alias("stop"))
        spans = whole.unionByName(extended.where("start is not null").select("doc_id", "t", "start", "stop")).unionByName(others)
        return made.keep(cut(spans.distinct().groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "repeats-spans"))


KEPT = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:int,stop:int>>"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
    for part in (x for batch in batches for x in slices(batch)):
        out = []
        for doc_id, text, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
            raw = (text or "").encode()
            starts, ends = bounds(raw)
            runs: list[list[int]] = []
            for a, z in sorted((s["start"], s["stop"]) for s in spans or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], z)
                else:
                    runs.append([a, z])
            edges = [0, *(x for r in runs for x in r), len(starts)]
            kept = [_GAP.sub(b" ", raw[starts[a] : ends[z - 1]]) for a, z in zip(edges[::2], edges[1::2], strict=True) if a < z]
            out.append((doc_id, len(starts), sum(z - a for a, z in runs), b" ".join(kept).decode(), [{"start": a, "stop": z} for a, z in runs]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept", "removed"])


def without_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space), removed (runs of words, [start, stop), ascending).

    Words are parted by ASCII white space and taken as they are. A word goes if any window
    of `length` words over it also starts in a document of smaller doc_id, whatever is
    removed there. Rows of one doc_id do not remove from each other, and rows that repeat an
    id and its text lose the same. Null and empty texts have no words; rows without an id
    stay whole and remove nothing; an empty table gives no rows. Other columns, whatever
    their names, are not read.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("t"))
    spans = repeated_spans(d, length).toDF("id", "of", "spans")
    joined = d.where("doc_id is not null").join(spans, (F.col("doc_id") == F.col("id")) & (F.col("t") == F.col("of")), "left").select("doc_id", "text", "spans")
    whole = d.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans"))
    return joined.unionByName(whole).mapInArrow(tidy(_kept), KEPT)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
