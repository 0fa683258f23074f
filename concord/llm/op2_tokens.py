"""Token counts from the frequencies of pre-tokens.

Texts are cut into pre-tokens, which a chunk of documents numbers in a dictionary of its own.
The dictionaries' entries go, by hash, to the one task that counts the pieces of each
distinct pre-token once; the counts go back to the chunks, where they meet the documents'
pre-token frequencies. No ids are made. What is shuffled is one entry per chunk and distinct
pre-token, so a frequent pre-token weighs no more than a rare one.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.tokens import added, tokenizer
from concord.plans.shared import cut

#: Characters of a chunk of documents, the fewest buckets that pre-tokens are dealt to, the limit of over_limit.
CHUNK_CHARS, BUCKETS, LIMIT = 24_000_000, 512, 2048
VOCABULARY = "word_bpe_49k.json"
#: Texts of these characters only take the fast route: Latin letters in every Unicode version, unchanged by NFC, lowered one to one.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ]")
_LETTER, _NUMBER = "a-zA-ZªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
#: The pattern of the vocabulary's pre-tokenizer, its classes spelt out for those characters.
_PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
_KNOWN = {"word_bpe_49k.json"}


@functools.lru_cache(maxsize=1)
def _byte_level():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=False)


def pre_tokens(text: str, name: str = VOCABULARY) -> tuple[Counter, Counter, int]:
    """(plain pre-tokens, pre-tokens as the model reads them, special strings) of a text."""
    special = added(name)
    if name in _KNOWN and not _OTHER.search(text) and not (special and special.search(text)):
        return Counter(_PRE.findall(text.lower())), Counter(), 0
    tok, out, n = tokenizer(name), Counter(), 0
    parts = [text]
    if special:
        n, parts = len(special.findall(text)), special.split(text)
    for part in parts:
        if part:
            norm = tok.normalizer.normalize_str(part) if tok.normalizer else part
            out.update(x for x, _ in (tok.pre_tokenizer.pre_tokenize_str(norm) if tok.pre_tokenizer else [(norm, None)]))
    return Counter(), out, n


def as_read(pre_token: str) -> str:
    """A plain pre-token as the model reads it: its bytes as characters."""
    return pre_token if pre_token.isascii() else _byte_level().pre_tokenize_str(pre_token)[0][0]


def pieces(pre_token: str, name: str = VOCABULARY) -> int:
    return len(tokenizer(name).model.tokenize(pre_token))


CHUNKS = "chunk long, doc_ids array<long>, n_bytes array<long>, extra array<long>, sizes array<int>, idx binary, freq binary, bucket int, start int, tokens binary"
_KINDS = {"chunk": pa.int64(), "doc_ids": pa.list_(pa.int64()), "n_bytes": pa.list_(pa.int64()), "extra": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "idx": pa.binary(), "freq": pa.binary(), "bucket": pa.int32(), "start": pa.int32(), "tokens": pa.binary()}


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in _KINDS.items()], list(_KINDS))


def packed(values: np.ndarray) -> bytes:
    """32-bit integers, the bytes of equal weight together, compressed."""
    return zstd.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstd.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").reshape(-1).astype(np.int64)


class _Chunk:
    def __init__(self) -> None:
        self.plain: dict[str, int] = {}
        self.read: dict[str, int] = {}
        self.chars, self.docs, self.idx, self.freq, self.n = 0, [], [], [], 0

    def add(self, doc_id: int | None, text: str, name: str) -> None:
        size = 0
        plain, read, extra = pre_tokens(text, name)
        for found, known in ((plain, self.plain), (read, self.read)):
            if found:
                size += len(found)
                at = np.empty(len(found), dtype=np.int32)
                for k, t in enumerate(found):
                    i = known.get(t)
                    if i is None:
                        i = known[t] = self.n
                        self.n += 1
                    at[k] = i
                self.idx.append(at)
                self.freq.append(np.fromiter(found.values(), dtype=np.int32, count=len(found)))
        self.docs.append((doc_id, len(text.encode()), extra, size))
        self.chars += len(text)

    def rows(self, chunk: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """The chunk's documents, and its dictionary by bucket; numbers run on from bucket to bucket."""
        entries = []
        for known, turn in ((self.plain, as_read), (self.read, str)):
            for t, i in known.items():
                t = turn(t)
                entries.append((zlib.crc32(t.encode()) % buckets, t, i))
        entries.sort()
        place = np.empty(len(entries), dtype=np.int64)
        place[[i for *_, i in entries]] = np.arange(len(entries))
        ids, n_bytes, extra, sizes = map(list, zip(*self.docs, strict=True))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        idx = place[np.concatenate(self.idx)] if self.idx else np.empty(0, dtype=np.int64)
        freq = np.concatenate(self.freq) if self.freq else np.empty(0, dtype=np.int32)
        order = np.lexsort((idx, owner))
        idx, freq = idx[order], freq[order]
        yield _rows([{"chunk": chunk, "doc_ids": ids, "n_bytes": n_bytes, "extra": extra, "sizes": sizes, "idx": packed(np.diff(idx, prepend=0)), "freq": packed(freq)}])
        out, start = [], 0
        press = zstd.ZstdCompressor(level=3)
        for b, group in itertools.groupby(entries, key=lambda e: e[0]):
            tokens = [t for _, t, _ in group]
            out.append({"chunk": chunk, "bucket": b, "start": start, "tokens": press.compress("\n".join(tokens).encode())})
            start += len(tokens)
        yield _rows(out)


def _encode(name: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, now = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now.add(doc_id, text or "", name)
                if now.chars >= CHUNK_CHARS:
                    yield from now.rows(chunk, buckets)
                    chunk, now = chunk + 1, _Chunk()
        if now.docs:
            yield from now.rows(chunk, buckets)

    return run


def _count(name: str):
    """Counts the pieces of each distinct pre-token of a bucket once; a bucket's rows come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        bucket, press = None, zstd.ZstdDecompressor()
        for batch in batches:
            out = []
            for b, tokens in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                counts = []
                for t in press.decompress(tokens).decode().split("\n"):  # a pre-token as the model reads it has no line feed
                    n = known.get(t)
                    if n is None:
                        n = known[t] = pieces(t, name)
                    counts.append(n)
                out.append(packed(np.array(counts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["chunk", "start", "pieces"])

    return run


def _sum(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    row = docs.iloc[0]
    counts = counts.sort_values("start")
    table = np.concatenate([np.empty(0, dtype=np.int64), *map(unpacked, counts["pieces"])])
    sizes = np.asarray(row["sizes"], dtype=np.int64)
    sums = np.concatenate(([0], np.cumsum(table[np.cumsum(unpacked(row["idx"]))] * unpacked(row["freq"]))))
    ends = np.cumsum(sizes)
    return pd.DataFrame({"doc_id": pd.array([None if x is None or x != x else int(x) for x in row["doc_ids"]], dtype="Int64"), "n_bytes": row["n_bytes"], "n_tokens": sums[ends] - sums[ends - sizes] + row["extra"]})


def buckets_of(partitions: int) -> int:
    """Buckets for an input of so many partitions: as its root, as distinct pre-tokens grow slower than text and each chunk has a row per bucket."""
    return max(BUCKETS, 1 << math.ceil(math.log2(16 * math.sqrt(max(1, partitions)))))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY, limit: int = LIMIT, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, as the tokenizer counts the whole text.

    Null text counts as empty: 0 bytes, 0 tokens. Null ids pass through, repeated rows are
    repeated, an empty table gives no rows, other columns are not read. Special strings of
    the vocabulary inside a text are one token each, as the library takes them by default.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = buckets or buckets_of(d.rdd.getNumPartitions())
    chunks = cut(d.mapInArrow(_encode(name, buckets), CHUNKS), "token-chunks")
    entries = chunks.where("bucket is not null").select("chunk", "bucket", "start", "tokens")
    counted = entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(name), "chunk long, start int, pieces binary")
    owners = chunks.where("bucket is null").select("chunk", "doc_ids", "n_bytes", "extra", "sizes", "idx", "freq")
    summed = owners.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInPandas(_sum, "doc_id long, n_bytes long, n_tokens long")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
