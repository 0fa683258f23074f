"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks. Two vectors with cosine c are at squared
distance 2 - 2c, so in one block at least their squared distance is within that block's
proportional share; a range join per block finds every such pair, and the pairs found are
verified on the full vectors in double precision. A label's vectors are dealt into a few
parts; each pair of parts is a tile, in which all blocks are joined, so that a vector is
sent once to each of its label's parts and not once for each block. A block's range join
sorts both sides by the block's leading coordinate and compares a run of one side with the
stretch of the other that lies within the block's radius.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.components import connected_components
from concord.plans.shared import cut, scratch

#: Dimensions of a block, rounding allowances on squared distances in double and in single precision.
BLOCK_DIMS, SLACK, ROUGH = 8, 1e-9, 1e-5
#: Rows of one side of a tile, parts of a label up to which they grow with it, rows of a side at most, rows compared at once.
TILE, PARTS, LARGEST, RUN = 2048, 8, 32768, 512


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A fixed orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_bounds(dims: int) -> list[tuple[int, int]]:
    return [(i, min(i + BLOCK_DIMS, dims)) for i in range(0, dims, BLOCK_DIMS)]


def budget(threshold: float, lo: int, hi: int, dims: int) -> float:
    """A block's share of the squared distance, in proportion to its dimensions."""
    return (2 - 2 * threshold) * (hi - lo) / dims + SLACK


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products summed column by column: every tile gets the same bits for the same rows."""
    out = a[:, 0] * b[:, 0]
    for k in range(1, a.shape[1]):
        out = out + a[:, k] * b[:, k]
    return out


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest components near 1, so that no square over- or underflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _turned(v: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; summed in a fixed order, so that tiles agree to the last bit."""
    unit, turn = v / np.sqrt(_dots(v, v))[:, None], rotation(v.shape[1])
    out = unit[:, :1] * turn[0]
    for k in range(1, v.shape[1]):
        out += unit[:, k : k + 1] * turn[k]
    return out


def _width(threshold: float, lo: int, hi: int, dims: int) -> float:
    """A little over a block's radius, so that leading coordinates of pairs within it differ by less whatever the rounding."""
    return math.sqrt(budget(threshold, lo, hi, dims)) * (1 + 1e-6)


def _placed(cells: DataFrame) -> DataFrame:
    """cells(label, dims, id, ...) -> each row once for each part of its label: with its part, and the tile (i, j), i <= j, of two parts.

    A label has PARTS parts at most, so that no row is sent more often, until a part would hold more than LARGEST rows.
    """
    n = F.count("*")
    parts = cells.groupBy("label", "dims").agg(F.greatest(F.least(F.ceil(n / TILE), F.lit(PARTS)), F.ceil(n / LARGEST)).cast("int").alias("parts"))
    dealt = cells.join(parts, ["label", "dims"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: F.struct(F.least("part", t).alias("i"), F.greatest("part", t).alias("j")))
    return dealt.withColumn("tile", F.explode(tiles)).select(*cells.columns, "part", "tile.*")


def _near(own: np.ndarray, left: np.ndarray, right: np.ndarray, radius: float, most: float):
    """Pairs of rows, of left and right, whose squared distance in a block is at most so large; in runs, with a few that are farther."""
    a, z = left[np.argsort(own[left, 0], kind="stable")], right[np.argsort(own[right, 0], kind="stable")]
    square, one = np.einsum("ij,ij->i", own, own), np.ones(len(own))
    rows = np.column_stack((own, square, one)).astype(np.float32)
    columns = np.column_stack((-2 * own, one, square)).astype(np.float32)[z]
    first, last = np.searchsorted(own[z, 0], own[a, 0] - radius), np.searchsorted(own[z, 0], own[a, 0] + radius, side="right")
    for at in range(0, len(a), RUN):
        run = a[at : at + RUN]
        lo, hi = first[at], last[at + len(run) - 1]
        x, y = np.nonzero(rows[run] @ columns[lo:hi].T <= np.float32(most + ROUGH))
        yield run[x], z[lo + y]


def _tile(threshold: float):
    """All links of one tile: a row per vector with its count of links, and links that join its components.

    A pair is counted where it is first found: in the lowest block whose budget it meets.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dims, i, j = (int(pdf[c].iat[0]) for c in ("dims", "i", "j"))
        v = _scaled(np.array(pdf["vec"].tolist(), dtype=np.float64))
        norm, turned = np.sqrt(_dots(v, v)), _turned(v)
        ids, copies, part = pdf["id"].to_numpy(), pdf["copies"].to_numpy(), pdf["part"].to_numpy()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        bounds = block_bounds(dims)
        count = np.zeros(len(pdf), dtype=np.int64)
        root = np.arange(len(pdf))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for block, (lo, hi) in enumerate(bounds):
            own = np.ascontiguousarray(turned[:, lo:hi])
            for a, z in _near(own, left, right, _width(threshold, lo, hi, dims), budget(threshold, lo, hi, dims)):
                if i == j:
                    once = a < z
                    a, z = a[once], z[once]
                for x in range(0, len(a), 65536):
                    p, q = a[x : x + 65536], z[x : x + 65536]
                    ok = _dots(v[p], v[q]) / (norm[p] * norm[q]) >= threshold
                    p, q = p[ok], q[ok]
                    for b, (lo2, hi2) in enumerate(bounds[: block + 1]):
                        diff = turned[p, lo2:hi2] - turned[q, lo2:hi2]
                        ok = (_dots(diff, diff) <= budget(threshold, lo2, hi2, dims)) == (b == block)
                        p, q = p[ok], q[ok]
                    np.add.at(count, p, copies[q])
                    np.add.at(count, q, copies[p])
                    for s, t in zip(p.tolist(), q.tolist(), strict=True):
                        s, t = find(s), find(t)
                        if s != t:
                            root[max(s, t)] = min(s, t)
        seen = np.flatnonzero(count)
        roots = np.array([find(x) for x in seen.tolist()], dtype=np.int64)
        return pd.DataFrame({"id": ids[seen], "n": count[seen], "root": ids[roots] if len(seen) else np.array([], dtype=np.int64)})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows are compared where their labels are equal and not null and their vectors have the
    same length. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing: 0 links, their own component, kept. Equal vectors of a label are
    joined once, by their smallest id, and count as linked with each other; so do repeated
    rows. A null id gives a row with null component and kept.
    """
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    good = v.where(fine).withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, 0).otherwise(x).cast(kind)))  # no negative zeros
    with scratch() as made:
        classes = cut(good.groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vectors")
        cells = classes.select(F.col("label").cast("string"), F.size("vec").alias("dims"), "id", "copies", "vec")
        found = cut(_placed(cells).groupBy("label", "dims", "i", "j").applyInPandas(_tile(threshold), "id long, n long, root long"), "embed-links")
        counts = found.groupBy("id").agg(F.sum("n").alias("n"))
        comps = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        for table in (classes, found, comps):  # the result reads them
            made.keep(table)
    done = classes.join(counts, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    done = done.select(F.col("label").alias("l"), F.col("vec").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = good.join(done, (F.col("label") == F.col("l")) & (F.col("vec") == F.col("w"))).select("vec_id", "n_links", "component_id")
    alone = v.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
