"""Packing documents into token sequences of near-equal attention cost.

A document's ids are cut at every full sequence; what is left is one piece. A piece costs
a linear part plus a quadratic one; pieces in descending order each go to the sequence of
lowest cost that has room. Where none has, the piece is cut to the room that is left. Pieces
are dealt by hash into shards of bounded size, each packed by one task. Checksums at a fixed
step are kept with a piece, so that a cut one's parts need no second tokenisation.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.batches import small_batches, tidy
from concord.llm.tokens import encode_ids
from concord.plans.shared import cut

CAPACITY, END_ID = 2048, 1
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens and pieces of a packing shard, and the step at which pieces can be cut.
SHARD_TOKENS, SHARD_PIECES, STEP = 1 << 24, 1 << 17, 16
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the checksum's, lowest power in the highest bit."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def _power(n: int) -> int:
    """x to the n modulo the checksum's polynomial."""
    out, x = 1 << 31, 1 << 30
    while n:
        if n & 1:
            out = _times(out, x)
        x, n = _times(x, x), n >> 1
    return out


def crc_between(before: int, through: int, n_bytes: int) -> int:
    """CRC-32 of the last n_bytes of a string, given that of the string without them and that of the whole."""
    return through ^ _times(_power(8 * n_bytes), before)


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class _Open:
    """Open sequences by room left: a heap by cost for each room, and the cheapest of any range of rooms."""

    def __init__(self, capacity: int) -> None:
        self.n = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.tree: list[tuple[float, int, int]] = [(float("inf"), -1, -1)] * (2 * self.n)

    def _fix(self, room: int) -> None:
        h, i = self.heaps[room], room + self.n
        self.tree[i] = (h[0][0], h[0][1], room) if h else (float("inf"), -1, -1)
        while i > 1:
            i //= 2
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = a if a <= b else b

    def put(self, c: float, seq: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (c, seq))
        self._fix(room)

    def take(self, need: int) -> tuple[float, int, int] | None:
        best, lo, hi = (float("inf"), -1, -1), need + self.n, 2 * self.n
        while lo < hi:
            if lo & 1:
                best = min(best, self.tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, self.tree[hi])
            lo, hi = lo // 2, hi // 2
        if best[1] < 0:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._fix(best[2])
        return best


def pack(lengths: list[int], capacity: int = CAPACITY, step: int = STEP) -> list[tuple[int, int, int, int, int]]:
    """(piece, first, length, sequence, offset) of each part; lengths are from 1 to capacity.

    A piece is cut only where no open sequence has room for it, at a multiple of step.
    """
    full = [i for i, n in enumerate(lengths) if n >= capacity]
    out = [(i, 0, lengths[i], k, 0) for k, i in enumerate(full)]
    heap = [(-n, i, 0) for i, n in enumerate(lengths) if n < capacity]
    heapq.heapify(heap)
    opened = -(-sum(-n for n, _, _ in heap) // capacity)
    sequences = _Open(capacity)
    for k in range(opened):
        sequences.put(0.0, len(full) + k, capacity)
    while heap:
        n, i, first = heapq.heappop(heap)
        n = -n
        best = sequences.take(n) or sequences.take(min(n, step))
        if best is None:
            best = (0.0, len(full) + opened, capacity)
            opened += 1
        c, seq, room = best
        part = n if room >= n else room // step * step
        out.append((i, first, part, seq, capacity - room))
        if room > part:
            sequences.put(c + cost(part), seq, room - part)
        if part < n:
            heapq.heappush(heap, (part - n, i, first + part))
    return out


PIECES = "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long, crcs array<long>"


def _pieces(capacity: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, row = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array(encode_ids(text or "", name) + [END_ID], dtype="<u4")
                row += 1
                for i in range(0, len(ids), capacity):
                    data, crc, crcs = ids[i : i + capacity].tobytes(), 0, []
                    if len(data) < 4 * capacity:  # only such a piece may be cut
                        for k in range(0, len(data), 4 * STEP):
                            crcs.append(crc)
                            crc = zlib.crc32(data[k : k + 4 * STEP], crc)
                    else:
                        crc = zlib.crc32(data)
                    out.append((doc_id, at + row, i, len(data) // 4, crc, len(ids), crcs))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return run


def _shard(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "copy"], ascending=[False, True, True, True], kind="stable", na_position="last")
        starts, crcs, whole, lengths = pdf["start"].tolist(), pdf["crcs"].tolist(), pdf["ids_crc32"].tolist(), pdf["length"].tolist()
        out = pack(lengths, capacity)

        def crc(i: int, first: int, n: int) -> int:
            through = whole[i] if first + n == lengths[i] else int(crcs[i][(first + n) // STEP])
            return crc_between(int(crcs[i][first // STEP]), through, 4 * n) if first else through

        i = np.array([x[0] for x in out])
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"].array[i], "start": [starts[x[0]] + x[1] for x in out], "length": [x[2] for x in out], "ids_crc32": [crc(*x[:3]) for x in out],
                "doc_tokens": pdf["doc_tokens"].to_numpy()[i], "sequence_id": [(int(pdf["shard"].iat[0]) << 32) + x[3] for x in out], "offset": [x[4] for x in out],
            }
        )

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, name: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Rows repeated are packed each by itself; a null
    doc_id is carried through; an empty table gives no rows; other columns are not read.
    Shards hold pieces, not documents, so neither a long document nor many copies fill one.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    pieces = cut(d.mapInArrow(tidy(_pieces(capacity, name)), PIECES), "pieces")
    total, rows = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-total // SHARD_TOKENS), -(-rows // SHARD_PIECES))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "copy"), F.lit(shards)).cast("int"))
    kinds = {x.split()[0]: x for x in PIECES.split(", ")}
    out = ", ".join(kinds[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) + ", sequence_id long, offset long"
    return dealt.groupBy("shard").applyInPandas(_shard(capacity), out)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
