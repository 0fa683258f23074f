"""Line deduplication by a deletion-neighbourhood join over words.

Equal lines meet by hash. The edit bound is one word (put in, left out or replaced) in lines of
at least MIN_WORDS words, and none in shorter ones, of which a word is too large a part. Lines
within the bound meet through their variants: a line emits the hash of itself and of itself
without each one word; lines with an equal variant are compared word by word. Only lines that
share a half with another line emit variants: one edit leaves one half of a line as it is. Of
equal or near lines the earliest is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.batches import slices, small_batches, tidy
from concord.llm.words import inverse_powers, mix64, powers, words
from concord.plans.shared import cut, free, scratch

#: Lines of fewer words have an edit bound of none.
MIN_WORDS = 8
#: Salts of the two halves of a 128-bit hash of a line.
_SALTS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xA3B195354A39B70D))


def _placed(w: np.ndarray, places: np.ndarray, salt: np.uint64) -> np.ndarray:
    """The hashes of words that stand at these places of a line; a line's hash is their sum."""
    return mix64(w ^ mix64(places.astype(np.uint64) + salt))


def _sums(x: np.ndarray) -> np.ndarray:
    """Of the numbers before each place, and of all."""
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def hashes_and_variants(w: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of lines of n words each, which stand in w one after another, for each half of a 128-bit hash: (the lines' hashes, for each word that of its line without it).

    Sums of hashes of word and place: no pattern of words makes them equal, but chance.
    """
    end = np.cumsum(n)
    first, line = end - n, np.repeat(np.arange(len(n)), n)
    place, size = np.arange(len(w)) - first[line], n.astype(np.uint64)
    out = []
    for salt in _SALTS:
        here, moved = _sums(_placed(w, place, salt)), _sums(_placed(w, place - 1, salt))
        rest = here[:-1] - here[first][line] + moved[end][line] - moved[1:] + ((size - np.uint64(1)) * salt)[line]
        out.append(((here[end] - here[first] + size * salt).view(np.int64), rest.view(np.int64)))
    return out


def line_hash(w: np.ndarray) -> list[int]:
    """The two halves of the hash of one line's words."""
    return [h.item() for h, _ in hashes_and_variants(w, np.array([len(w)]))]


def variants(w: np.ndarray) -> list[np.ndarray]:
    """line_hash of the line without each one of its words."""
    return [rest for _, rest in hashes_and_variants(w, np.array([len(w)]))]


class Lines:
    """Hashes of any run of words of a text's lines, in constant time each: keys that bring lines together, and decide nothing."""

    def __init__(self, text: str | None) -> None:
        w, starts, raw = words(text, lower=False)
        breaks = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)
        self.n_lines = len(breaks) + 1
        line = np.searchsorted(breaks, starts)
        self.words = w
        self.first = np.searchsorted(line, np.arange(self.n_lines))  # a line's first word
        self.end = np.searchsorted(line, np.arange(self.n_lines), side="right")
        self.run = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(w * powers(len(w) + 1)[: len(w)], dtype=np.uint64)))

    def value(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Of the words from a up to z, as if they stood at the beginning."""
        return (self.run[z] - self.run[a]) * inverse_powers(len(self.run))[a]

    def hash(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return mix64(self.value(a, z) + ((z - a).astype(np.uint64) << np.uint64(32)))


LINES = "doc_id long, t long, line int, h1 long, h2 long, n int, keys array<long>, again boolean"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _lines(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            texts = [x or "" for x in part.column(1).to_pylist()]
            whole = "\n".join(texts)
            t = Lines(whole)  # the documents' lines one after another
            counts = np.array([x.count("\n") + 1 for x in texts])
            doc = np.repeat(np.arange(len(texts)), counts)
            line = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = np.flatnonzero(t.end > t.first)
            a, z, doc, line = t.first[at], t.end[at], doc[at], line[at]
            digests = [xxhash.xxh3_128_digest(b" ".join(w)) for x in whole.encode().split(b"\n") if (w := x.split())]
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)  # of a line's words
            n = z - a
            keys = []
            for size in (n, n - 1):  # halves of a line of this size, and of one a word shorter
                half = size // 2
                salt = size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
                keys += [mix64(t.hash(a, a + half) + salt), mix64(t.hash(z - (size - half), z) + salt + np.uint64(1))]
            keys = np.stack(keys, axis=1).view(np.int64)
            order = np.lexsort((line, h[:, 1], h[:, 0], doc))
            again = np.zeros(len(at), dtype=bool)
            again[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (h[order[1:]] == h[order[:-1]]).all(axis=1)
            use = (n >= min_words) & ~again
            offsets = pa.array(np.concatenate(([0], np.cumsum(use * 4))), pa.int32())
            rows = pa.array(doc)
            columns = [part.column(0).take(rows), part.column(2).take(rows), pa.array(line, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(n, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(keys[use].reshape(-1))), pa.array(again)]
            yield pa.RecordBatch.from_arrays(columns, _names(LINES))

    return run


SUSPECTS = "doc_id long, t long, line int, n int, h1 long, h2 long, x long, y long, words string, vx array<long>, vy array<long>"


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for whole in batches for x in slices(whole, column=2)):
        rows, numbers, own = [], [], []
        for i, (text, at) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            lines, at = (text or "").split("\n"), sorted(set(at))
            rows += [i] * len(at)
            numbers += at
            own += [b" ".join(lines[k].encode().split()) for k in at]
        if not rows:
            continue
        n = np.array([x.count(b" ") + 1 for x in own])
        own_words = words(b"\n".join(own).decode(), lower=False)[0]  # the lines' words together, not document by document
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, own)), dtype="<i8").reshape(-1, 2)
        (x, vx), (y, vy) = hashes_and_variants(own_words, n)
        offsets, at = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(rows)
        columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(n, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(x), pa.array(y), pa.array([x.decode() for x in own], pa.string())]
        columns += [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (vx, vy)]
        yield pa.RecordBatch.from_arrays(columns, _names(SUSPECTS))


def within_one(a: list[str], b: list[str]) -> bool:
    """True if one edit at most, of one word, turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = [within_one(x.split(" "), y.split(" ")) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["h1", "h2"]).filter(pa.array(same, pa.bool_()))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t, dropped): the lines to drop of each row that has some: an equal or near line stands earlier.

    docs(doc_id, text, t), t the hash of the text: a row is known by doc_id and t, and lines
    stand in order of doc_id, t and line number. Lines are equal if the 128-bit hashes of
    their words are.
    """
    small_batches(docs.sparkSession)
    with scratch() as made:
        lines = cut(docs.where("doc_id is not null").select("doc_id", "text", "t").mapInArrow(tidy(_lines(min_words)), LINES), "lines")
        once = lines.where("not again")
        # a common line's rows are counted down before they are shuffled, and split where they meet its first row
        firsts = cut(once.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "t")).alias("owner")), "lines-first")
        owned = once.join(firsts, ["h1", "h2"]).withColumn("is_first", F.struct("doc_id", "t") == F.col("owner")).drop("owner", "again")
        owned = cut(owned, "lines-owned")
        again = cut(lines.where("again").select("doc_id", "t", "line"), "lines-again")
        free(lines, firsts)
        first = owned.where("is_first")
        keyed = first.select("h1", F.explode("keys").alias("key"))
        shared = cut(keyed.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y"), F.count("*").alias("n")).where("x <> y"), "lines-shared")
        two = shared.where("n = 2").select(F.explode(F.array("x", "y")).alias("h1"))
        many = cut(shared.where("n > 2").select("key"), "lines-many")
        some = two.unionByName(keyed.join(many, "key", "left_semi").select("h1")).distinct()
        wanted = first.join(some, "h1", "left_semi").groupBy(F.col("doc_id").alias("id"), F.col("t").alias("of")).agg(F.collect_list("line").alias("at"))
        found = docs.join(wanted, (F.col("doc_id") == F.col("id")) & (F.col("t") == F.col("of"))).select("doc_id", "t", "text", "at").mapInArrow(tidy(_suspects), SUSPECTS)
        suspects = cut(found.withColumn("at", F.struct("doc_id", "t", "line")).drop("doc_id", "t", "line"), "lines-suspects")
        free(shared, many)
        variants = suspects.select("at", "n", "h1", "h2", F.posexplode(F.arrays_zip("vx", "vy")).alias("word", "key")).select("at", "n", "h1", "h2", "word", "key.vx", "key.vy")
        # one word replaced: equal without the word at the same place; one word more: equal to the shorter line itself
        replaced = variants.groupBy("n", "word", "vx", "vy").agg(F.min("at").alias("least"), F.max("at").alias("most")).where("least < most").drop("most")
        replaced = variants.join(replaced, ["n", "word", "vx", "vy"]).where("at > least").select("h1", "h2", F.col("at").alias("later"), F.col("least").alias("earlier"))
        short = suspects.select(F.col("n").alias("size"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.struct("h1", "h2").alias("short"), F.col("at").alias("at_short"))
        met = variants.withColumn("size", F.col("n") - 1).join(short, ["size", "vx", "vy"])
        put_in = met.where("at > at_short").select("h1", "h2", F.col("at").alias("later"), F.col("at_short").alias("earlier"))
        left_out = met.where("at < at_short").groupBy("short", "at_short").agg(F.min("at").alias("earlier")).select("short.*", F.col("at_short").alias("later"), "earlier")
        pairs = replaced.unionByName(put_in).unionByName(left_out).distinct()
        own = suspects.select(F.col("at").alias("later"), F.col("words").alias("x"))
        other = suspects.select(F.col("at").alias("earlier"), F.col("words").alias("y"))
        near = pairs.join(own, "later").join(other, "earlier").select("h1", "h2", "x", "y").mapInArrow(_check, "h1 long, h2 long").distinct()
        near = cut(near.withColumn("near", F.lit(True)), "lines-near")
        # a near line's other occurrences all stand later than the one compared
        gone = owned.join(near, ["h1", "h2"], "left").where(~F.col("is_first") | F.col("near")).select("doc_id", "t", "line").unionByName(again)
        return made.keep(cut(gone.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("line")).alias("dropped")), "lines-dropped"))


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns (text, dropped, others) -> (what is left of the text, lines, dropped lines, others)."""
    for batch in (x for whole in batches for x in slices(whole, column=0)):
        rows = []
        for text, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is None:
                rows.append((None, 0, 0))
                continue
            lines, drop = text.split("\n"), set(gone or ())
            rows.append(("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text, len(lines), len(drop)))
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), *batch.columns[1:]], ["c0", "c1", "c2", *(f"c{i + 2}" for i in range(1, batch.num_columns))])


def _rested(docs: DataFrame, id_col: str, text_col: str, others: list[str], min_words: int) -> DataFrame:
    """c0: what is left of the text, c1: its lines, c2: lines dropped, c3: their numbers, then the others as c4 and so on.

    Columns go by position throughout, so that no name of docs can clash.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    d = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(F.col(text_col)), *[F.col(f"`{c}`") for c in others])
    d = d.toDF("doc_id", "text", "t", *(f"c{i + 4}" for i in range(len(others))))
    gone = repeated_lines(d.select("doc_id", "text", "t"), min_words).toDF("id", "of", "dropped")
    joined = d.join(gone, (F.col("doc_id") == F.col("id")) & (F.col("t") == F.col("of")), "left")
    joined = joined.select("text", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), *(f"c{i + 4}" for i in range(len(others))))
    return joined.mapInArrow(tidy(_rest), "c0 string, c1 long, c2 long, c3 array<int>" + "".join(f", c{i + 4} {kinds[c]}" for i, c in enumerate(others)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text (what is left), dropped (line numbers from 0, ascending).

    Lines are parted by line feeds; words by ASCII white space, which alone does not make
    lines differ. Blank lines stay. Order is by doc_id, then by the hash of the text where
    rows of one id differ in it, then by line: of equal or near lines the first is kept, and
    a line goes even where the line before it that it equals has gone itself. Rows that are
    the same in id and text drop alike. Null text stays null with 0 lines; rows without an
    id stay whole; an empty table gives no rows; other columns are not read.
    """
    out = _rested(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", ["doc_id"], min_words)
    return out.select(F.col("c4").cast("long").alias("doc_id"), F.col("c1").alias("n_lines"), F.col("c2").alias("n_dropped"), F.col("c0").alias("text"), F.col("c3").alias("dropped"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated lines taken out of text and n_chars, if there is one, set anew; documents of which nothing but blank is left go.

    Documents that were blank before stay. Rows, ids and ties are as in dedup_lines; the
    other columns pass through whatever their names, n_lines, dropped and t among them.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = _rested(docs, "doc_id", "text", others, min_words).where("c2 = 0 or c0 rlike '[^ \\\\t-\\\\r]'")
    at = {c: F.col(f"c{i + 4}") for i, c in enumerate(others)} | {"text": F.col("c0")}
    if "n_chars" in docs.columns:
        at["n_chars"] = F.length("c0").cast(docs.schema["n_chars"].dataType)
    return out.select(*(at[c].alias(c) for c in docs.columns))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
