"""N-gram Jaccard join, heavy-light by set size.

Small sets enumerate their subsets of the overlap's size: linked sets share one. Large sets
go to inverted lists. A list per single shingle would hold a third of all rows where a
passage is common, so a list's key is a block of the set's shingles: shingles are dealt by
hash into more blocks than linked sets can differ in, hence one block at least is the same
in both. The boundary is the size up to which subsets cost less than lists. Sets equal as a
whole are joined once, by their smallest document.

In a list all sets are compared with the smallest document's. Lists whose sets do not end in
one component compare those of different components, one list for each distinct collection of
sets, in tiles of bounded size and by parity sketches: the bits in which two sketches differ
are at most the shingles in which the sets do, so a pair with too many is no link. Sketches
grow with their sets, up to a bound that keeps a tile in memory. Of the rest a tile hands on a
few pairs for each two components they would join, and again until nothing is left to join. Every pair handed on is
verified on the exact sets, so no link between components is lost and copies are never
paired off.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.batches import slices, small_batches, tidy
from concord.llm.words import mix64, shingles
from concord.operators.components import connected_components
from concord.plans.shared import cut, free, scratch

_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Ratio of the sizes at a class's ends. A block with fewer shingles says little, and is left out where enough others remain.
RATIO, WEAK = 1.5, 2
#: 64-bit words of a parity sketch, members of one side of a tile, pairs tried at once for each join of a tile.
SKETCH, TILE, FORESTS = 16, 2048, 32
#: Bytes of a long sketch that go to a tile; longer ones are folded. Bytes of sketches compared at once there.
CARRY, COMPARED = 8192, 1 << 23
#: Keys of a part of a task, whose documents meet before the shuffle, and of a row that carries them.
PART_KEYS, ROW_KEYS = 1 << 19, 1 << 12


def differ(total: int, percent: int) -> int:
    """How many shingles two linked sets of `total` shingles together can differ in."""
    return total * (100 - percent) // (100 + percent)


def overlap(a: int, b: int, percent: int) -> int:
    """The least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def partners(s: int, percent: int) -> range:
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def subset_sizes(s: int, bound: int, percent: int) -> list[int]:
    """Sizes of the subsets that a set of size s enumerates for pairs whose smaller set has at most `bound` shingles."""
    return sorted({c for t in partners(s, percent) if min(s, t) <= bound and (c := overlap(s, t, percent)) <= min(s, t)})


def boundary(percent: int, most: int = 64) -> int:
    """The largest size up to which enumerating subsets costs less than lists and the check of a candidate."""
    x = 0
    for s in range(1, most):
        light = sum(math.comb(s, c) for c in subset_sizes(s, s, percent))
        heavy = 2 * (differ(2 * s, percent) + 1) + s
        if light > heavy:
            break
        x = s
    return x


def classes(s: int, bound: int, percent: int) -> list[tuple[int, int]]:
    """(label, shingles that pairs under it can differ in) of a set of size s > bound.

    Class k holds sizes from edge k up to the next edge. Label 2k serves pairs inside class
    k, label 2k + 1 pairs across its upper edge.
    """
    lo, k = bound + 1, 0
    while (up := max(lo + 1, math.ceil(lo * RATIO))) <= s:
        lo, k = up, k + 1
    out = [(2 * k, differ(2 * (up - 1), percent))]
    if 100 * s // percent >= up:
        out.append((2 * k + 1, differ(up - 1 + 100 * (up - 1) // percent, percent)))
    if k and -(-percent * s // 100) <= lo - 1:
        out.append((2 * k - 1, differ(lo - 1 + 100 * (lo - 1) // percent, percent)))
    return out


def signatures(shingle_set: np.ndarray, bound: int, percent: int) -> np.ndarray:
    """The keys under which a set meets every set it can be linked with."""
    s, out = len(shingle_set), []
    if not s:
        return np.empty(0, dtype=np.int64)
    mixed = mix64(shingle_set ^ _B)
    if partners(s, percent)[0] <= bound:
        total = mixed.sum(dtype=np.uint64)
        for c in subset_sizes(s, bound, percent):
            gone = np.array([sum((int(mixed[i]) for i in x), 0) & 0xFFFFFFFFFFFFFFFF for x in itertools.combinations(range(s), s - c)], dtype=np.uint64)
            out.append(mix64((total - gone) * _A + np.uint64(c)))
    if s > bound:
        run = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mixed, dtype=np.uint64)))
        high = shingle_set >> np.uint64(32)
        for label, d in classes(s, bound, percent):
            spare = 1 + d // 32
            n = d + 1 + spare
            block = ((high * np.uint64(n)) >> np.uint64(32)).astype(np.int64)  # ascending, as the set is
            ends = np.searchsorted(block, np.arange(n + 1))
            size = np.diff(ends)
            key = mix64((run[ends[1:]] - run[ends[:-1]]) * _A + np.arange(n, dtype=np.uint64) + (np.uint64(label + 1) << np.uint64(40)))
            weak = size < WEAK
            out.append(key if weak.sum() > spare else key[~weak])
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, dtype=np.int64)


def sketch(shingle_set: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """A bit for each of its hash values, set if an odd number of shingles have it; words is a power of two."""
    odd = np.bincount((mix64(shingle_set + _B) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def long_sketch(shingle_set: np.ndarray) -> bytes | None:
    """For sets that a sketch of SKETCH words is too short for: one with two bits or more for each shingle."""
    words = 1 << max(0, (2 * len(shingle_set) - 1).bit_length() - 6)
    return sketch(shingle_set, words).tobytes() if words > SKETCH else None


def folded(x: bytes) -> bytes:
    """A long sketch of at most CARRY bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.uint64).reshape(-1, min(len(x), CARRY) // 8), axis=0).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded to the shorter one's length."""
    u, v = sorted((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(v.reshape(-1, len(u)), axis=0) ^ u).sum(dtype=np.int64))


SETS = "doc_id long, n long, k1 long, k2 long, sketch array<long>, long binary, mid binary, sigs array<long>, docs array<long>, met_sigs array<long>, met_docs array<long>, met_pivots array<long>"
_LONGS = pa.list_(pa.int64())
_KINDS = dict(zip([x.split()[0] for x in SETS.split(", ")], [pa.int64()] * 4 + [_LONGS, pa.binary(), pa.binary()] + [_LONGS] * 5, strict=True))


def _sets(n: int, percent: int):
    """A row per document, and rows of keys: of a part of a task each distinct key once, with its smallest document.

    Documents of one part that share a key meet there; so a key that many documents share
    is shuffled once per part.
    """
    bound = boundary(percent)

    def rows(columns: dict[str, list]) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(k, [None] * size), t) for k, t in _KINDS.items()], list(_KINDS))

    def keys(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        sig, doc = np.concatenate([x for _, x in held]), np.repeat([i for i, _ in held], [len(x) for _, x in held])
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0) if len(sig) else np.empty(0, dtype=np.int64)
        counts = np.diff(np.append(first, len(sig)))
        met = np.repeat(counts > 1, counts)
        pivots = np.repeat(doc[first], counts)
        columns = {"sigs": sig[first], "docs": doc[first], "met_sigs": sig[met], "met_docs": doc[met], "met_pivots": pivots[met]}
        longest = max(len(first), int(met.sum()))
        return rows({k: [v[i : i + ROW_KEYS] for i in range(0, longest, ROW_KEYS)] for k, v in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for batch in (x for whole in batches for x in slices(whole)):
            out: dict[str, list] = {k: [] for k in ("doc_id", "n", "k1", "k2", "sketch", "long", "mid")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(text, n)
                long = long_sketch(s)
                row = (doc_id, len(s), int(mix64(s + _A).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix64(s * _B)).view(np.int64)) if len(s) else 0, sketch(s), long, folded(long) if long else None)
                for column, x in zip(out.values(), row, strict=True):
                    column.append(x)
                if doc_id is not None and len(s):
                    held.append((doc_id, signatures(s, bound, percent)))
                    size += len(held[-1][1])
            yield rows(out)
            if size >= PART_KEYS:
                yield keys(held)
                held, size = [], 0
        if held:
            yield keys(held)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, doc_id) -> (sig, doc_id, pivot) of keys that several documents have; one batch in memory."""
    open_sig, pivot, count = None, None, 0  # the last key, which may go on, its pivot and rows so far

    def out(sig: np.ndarray, doc: np.ndarray, pivots: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(doc, pa.int64()), pa.array(pivots, pa.int64())], ["sig", "doc_id", "pivot"])

    for batch in batches:
        sig, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(sig):
            continue
        first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0)
        counts = np.diff(np.append(first, len(sig)))
        pivots, many = np.repeat(doc[first], counts), np.repeat(counts > 1, counts)
        if open_sig is not None and sig[0] == open_sig:  # the batch goes on with the last one's key
            n = int(counts[0])
            pivots[:n], many[:n] = pivot, True
            if count == 1:
                yield out(np.array([open_sig]), np.array([pivot]), np.array([pivot]))
            counts[0] += count
        yield out(sig[many], doc[many], pivots[many])
        open_sig, pivot, count = int(sig[-1]), int(pivots[-1]), int(counts[-1])


#: Sets that a task of _verify keeps for rows to come, and the shingles of all of them at most.
KEPT_SETS, KEPT_ITEMS = 64, 1 << 20


def _verify(n: int, percent: int):
    """Rows (a, b, text of a, text of b) -> the pairs that are linked. A text that many rows share is cut into shingles a few times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        room = KEPT_ITEMS

        def items(text: str) -> np.ndarray:
            nonlocal room
            if (found := known.pop(text, None)) is None:
                found = shingles(text, n)
                room -= len(found)
            known[text] = found  # the last used last
            while len(known) > 1 and (room < 0 or len(known) > KEPT_SETS):
                room += len(known.pop(next(iter(known))))
            return found

        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = items(batch.column(2)[i].as_py()), items(batch.column(3)[i].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs(a, b) those whose sets are linked. Texts travel, not sets: a word takes less room than a hash for each shingle."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = cut(docs.where("text is not null").join(wanted, docs.doc_id == wanted.id, "left_semi").select(F.col("doc_id").alias("id"), "text"), "jaccard-texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    out = cut(both.select("a", "b", "x", "y").mapInArrow(tidy(_verify(n, percent)), "a long, b long"), "jaccard-links")
    free(texts)
    return out


class _Longs:
    """The long sketches of a tile's rows, stacked by length."""

    def __init__(self, sketches: np.ndarray) -> None:
        self.size = np.array([0 if x is None else len(x) for x in sketches], dtype=np.int64)
        self.place = np.zeros(len(sketches), dtype=np.int64)
        self.stacks: dict[int, np.ndarray] = {}
        for size in np.unique(self.size[self.size > 0]).tolist():
            at = np.flatnonzero(self.size == size)
            self.place[at] = np.arange(len(at))
            self.stacks[size] = np.frombuffer(b"".join(sketches[at]), dtype=np.uint64).reshape(len(at), -1)

    def allow(self, u: np.ndarray, v: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Of pairs of rows those that differ in at most so many bits; a row without a long sketch refutes nothing."""
        ok = np.ones(len(u), dtype=bool)
        for x in self.stacks:
            for y in self.stacks:
                which = np.flatnonzero((self.size[u] == x) & (self.size[v] == y))
                step, width = max(1, COMPARED // max(x, y)), min(x, y) // 8
                for at in range(0, len(which), step):
                    w = which[at : at + step]
                    p, q = (np.bitwise_xor.reduce(self.stacks[z][self.place[r[w]]].reshape(len(w), -1, width), axis=1) for z, r in ((x, u), (y, v)))
                    ok[w] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64) <= most[w]
        return ok


def _join_tiles(percent: int):
    """Sorted rows of tiles -> pairs, a few for each two components of a tile that pairs seem to link."""

    def pairs(rows: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
        own, i, j = rows["salt"], rows["i"][0], rows["j"][0]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        n, part, bits = rows["n"], rows["part"], rows["bits"]
        known = {(int(x), int(y)) for x, refuted in zip(rows["a"], rows["not_b"], strict=True) if refuted is not None for y in refuted}
        found: list[tuple[int, int, int]] = []
        longs = _Longs(rows["long"])
        forests: list[dict[int, int]] = [{} for _ in range(FORESTS)]

        def joins(q: int, r: int) -> bool:
            """True if the first forest in which q and r are apart now joins them."""
            for root in forests:
                x, y = q, r
                while x in root:
                    x = root[x]
                while y in root:
                    y = root[y]
                if x != y:
                    root[max(x, y)] = min(x, y)
                    return True
            return False

        for at in range(0, len(left), 64):
            p = left[at : at + 64]
            apart = part[p][:, None] != part[right][None, :]
            low, high = np.minimum(n[p][:, None], n[right][None, :]), np.maximum(n[p][:, None], n[right][None, :])
            apart &= (100 * low >= percent * high) & (rows["a"][p][:, None] != rows["pivot"][right][None, :])
            apart &= rows["pivot"][p][:, None] != rows["a"][right][None, :]  # those have been compared
            x, y = np.nonzero(apart)
            for lo in range(0, len(x), 1 << 16):
                u, v = p[x[lo : lo + (1 << 16)]], right[y[lo : lo + (1 << 16)]]
                far = np.bitwise_count(bits[u] ^ bits[v]).sum(axis=1, dtype=np.int64)
                most = (n[u] + n[v]) * (100 - percent) // (100 + percent)
                u, v, most = (z[far <= most] for z in (u, v, most))
                ok = longs.allow(u, v, most)
                for s, t in zip(u[ok].tolist(), v[ok].tolist(), strict=True):
                    a, b = int(rows["a"][s]), int(rows["a"][t])
                    a, b = min(a, b), max(a, b)
                    if (a, b) not in known and joins(int(part[s]), int(part[t])):
                        found.append((int(rows["sig"][s]), a, b))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def out(groups: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
            rows = [x for g in groups for x in pairs(g)]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["sig", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("sig", "i", "j", "salt", "a", "n", "part", "pivot")}
            rows["not_b"] = np.empty(batch.num_rows, dtype=object)
            rows["not_b"][:] = batch.column("not_b").to_pylist()
            rows["long"] = np.empty(batch.num_rows, dtype=object)
            rows["long"][:] = batch.column("long").to_pylist()
            # unsigned, as numpy counts the bits of a negative number's absolute value
            rows["bits"] = batch.column("sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH)
            if held is not None:
                rows = {k: np.concatenate((held[k], rows[k])) for k in rows}
            edge = np.flatnonzero((np.diff(rows["sig"]) != 0) | (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0)) + 1
            ends = [0, *edge.tolist()]
            groups = [{k: v[s:e] for k, v in rows.items()} for s, e in zip(ends[:-1], ends[1:], strict=True)]
            held = {k: v[ends[-1] :] for k, v in rows.items()}
            yield out(groups)
        if held is not None:
            yield out([held])

    return run


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [x is None or y is None or apart(x, y) <= most for most, x, y in zip(*(batch.column(k).to_pylist() for k in ("most", "l_a", "l_b")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def sketched(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) those whose sizes and sketches allow a link: the short sketches first, then the long ones."""
    x = reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    y = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    both = pairs.join(x, "a").join(y, "b").withColumn("most", F.expr(f"((n_a + n_b) * {100 - percent}) div {100 + percent}"))
    far = F.aggregate(F.zip_with("s_a", "s_b", lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int")), F.lit(0), lambda m, v: m + v)
    close = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)") & (far <= F.col("most"))
    some = cut(both.where(close).select("a", "b", "most").distinct(), "jaccard-close")
    longs = reps.where("long is not null")
    left = some.join(longs.select(F.col("rep").alias("a"), F.col("long").alias("l_a")), "a", "left").join(longs.select(F.col("rep").alias("b"), F.col("long").alias("l_b")), "b", "left")
    out = cut(left.mapInArrow(tidy(_near(percent)), "a long, b long").distinct(), "jaccard-pairs")
    free(some)
    return out


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set is its distinct n-word shingles; two link when 100 * intersection >=
    percent * union. Null, empty and blank texts have empty sets and link with nothing.
    Equal texts, and so repeated rows, are linked. Rows with a null id come back with a null
    component and link nobody; rows of one id with different texts pool their links. Other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    with scratch() as made:
        return made.keep(_components_of(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), n, percent))


def _components_of(d: DataFrame, n: int, percent: int) -> DataFrame:
    base = cut(d.mapInArrow(tidy(_sets(n, percent)), SETS), "jaccard-base")
    some = base.where("n > 0 and doc_id is not null")
    same = some.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    members = cut(some.select("doc_id", "n", "k1", "k2").join(same, ["n", "k1", "k2"]).select("doc_id", "rep", "n").distinct(), "jaccard-members")
    reps = some.select(F.col("doc_id").alias("rep"), "n", "sketch", "long", "mid")

    keyed = base.where("sigs is not null").select(F.inline(F.arrays_zip("sigs", "docs"))).toDF("sig", "doc_id")
    met = base.where("sigs is not null").select(F.inline(F.arrays_zip("met_sigs", "met_docs", "met_pivots"))).toDF("sig", "doc_id", "pivot")
    # one exchange: at most a row per key and part of a task, sorted and read as a stream
    lists = keyed.repartition("sig").sortWithinPartitions("sig", "doc_id").mapInArrow(tidy(_meet), "sig long, doc_id long, pivot long")
    hits = cut(lists.unionByName(met), "jaccard-hits")
    star = hits.where("doc_id <> pivot").select("doc_id", "pivot").distinct()
    a = members.select("doc_id", F.col("rep").alias("a"))
    b = members.select(F.col("doc_id").alias("pivot"), F.col("rep").alias("b"))
    star = cut(star.join(a, "doc_id").join(b, "pivot").where("a <> b"), "jaccard-star")
    pairs = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = sketched(pairs, reps, percent)
    links = verified(pairs, d, n, percent)
    free(pairs)
    parts = connected_components(links)

    # lists whose sets lie in several components: look for links between those
    def part(col: str) -> DataFrame:
        return parts.select(F.col("node").alias(col), F.col("component").alias(f"{col}_part"))

    split = star.join(part("a"), "a", "left").join(part("b"), "b", "left").where(F.coalesce("a_part", "a") != F.coalesce("b_part", "b"))
    open_lists = hits.join(split.select("doc_id", "pivot").distinct(), ["doc_id", "pivot"], "left_semi").select("sig").distinct()
    left = hits.join(open_lists, "sig", "left_semi").join(a, "doc_id")
    pivot = members.select(F.col("doc_id").alias("pivot"), F.col("rep").alias("first"))
    left = left.join(pivot, "pivot").groupBy("sig", "a").agg(F.min("first").alias("pivot"))
    # lists of the same sets hold the same pairs: one of them is enough
    held = [F.sum(F.xxhash64("a", F.lit(x)).cast("decimal(20,0)")).alias(f"held{x}") for x in (0, 1)]
    size = left.groupBy("sig").agg(F.count("*").alias("members"), *held).where("members > 2")
    size = size.groupBy("members", "held0", "held1").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("members") / TILE).cast("int").alias("salts"))
    left = left.join(size, "sig").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda t: F.struct(F.least("salt", t).alias("i"), F.greatest("salt", t).alias("j")))
    left = cut(left.withColumn("tile", F.explode(tiles)).select("sig", "a", "pivot", "salt", "tile.*"), "jaccard-open")
    free(hits, star)
    refuted: DataFrame | None = None
    while not left.isEmpty():
        rows = left.join(part("a"), "a", "left").withColumn("part", F.coalesce("a_part", "a")).drop("a_part")
        rows = rows.join(reps.select(F.col("rep").alias("a"), "n", "sketch", F.col("mid").alias("long")), "a")
        if refuted is None:
            rows = rows.withColumn("not_b", F.lit(None).cast("array<long>"))
        else:
            rows = rows.join(refuted.groupBy("sig", "a").agg(F.collect_set("not_b").alias("not_b")), ["sig", "a"], "left")
        rows = rows.select("sig", "i", "j", "salt", "a", "n", "part", "pivot", "not_b", "sketch", "long")
        rows = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "a")
        found = cut(rows.mapInArrow(tidy(_join_tiles(percent)), "sig long, a long, b long"), "jaccard-found")
        if found.isEmpty():
            break
        pairs = sketched(found.select("a", "b").distinct(), reps, percent)
        good = verified(pairs, d, n, percent)
        bad = found.join(good, ["a", "b"], "left_anti").select("sig", "a", F.col("b").alias("not_b"))
        before, refuted = refuted, cut(bad if refuted is None else refuted.unionByName(bad).distinct(), "jaccard-refuted")
        # components only merge and refuted pairs only grow: a list that found nothing stays done
        old, left = left, cut(left.join(found.select("sig").distinct(), "sig", "left_semi"), "jaccard-open")
        free(pairs, found, old, *([before] if before is not None else []))
        if good.isEmpty():
            free(good)
        else:
            both, links = (links, good), cut(links.unionByName(good), "jaccard-links")
            free(*both)
            last, parts = parts, connected_components(links)
            free(last)
    of = members.join(parts, members.rep == parts.node, "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "rep").alias("component"))
    of = of.groupBy("id").agg(F.min("component").alias("component"))
    joined = base.where("n is not null").select("doc_id", "n").join(of, base.doc_id == of.id, "left")
    return cut(joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")), "jaccard-components")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, all columns kept; documents without an id or words stay.

    Of the rows that repeat an id one stays, the first by text and then by its other columns.
    Null, empty and blank texts are linked with nothing; other columns may have any names.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = jaccard_components(docs, n, percent)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*columns)
    repeated = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "jaccard-repeated")
    if repeated.isEmpty():
        return kept
    row = F.struct(*columns)
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").select(*columns).unionByName(one.select("row.*"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
