"""Intermediate tables in the folder of spark.checkpoint.dir, which driver and executors share.

Lineage is cut by writing a Parquet table there and reading it again, so a lost executor
costs a re-read and never a recomputation of everything before it. A table lives until the
scratch() it was made in ends, or until the driver's JVM does where it was made in none.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """The tables made since a scratch() began."""

    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Hand a table made by cut() on to the scratch around this one."""
        self.paths.pop(df._concord_path, None)
        if (outer := _outer.get()) is not None:
            outer.paths[df._concord_path] = df.sparkSession
        return df


_now: ContextVar[Scratch | None] = ContextVar("scratch", default=None)
_outer: ContextVar[Scratch | None] = ContextVar("outer_scratch", default=None)


@contextlib.contextmanager
def scratch() -> Iterator[Scratch]:
    """Tables made inside are deleted at the end, but for those kept: nothing that outlives it may read them."""
    s, outer = Scratch(), _now.get()
    tokens = _outer.set(outer), _now.set(s)
    try:
        yield s
    finally:
        _now.reset(tokens[1])
        _outer.reset(tokens[0])
        for path, spark in s.paths.items():
            _delete(spark, path)


def free(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing to come reads."""
    for df in tables:
        if (s := _now.get()) is not None:
            s.paths.pop(df._concord_path, None)
        _delete(df.sparkSession, df._concord_path)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a local master a temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="concord-")
        _at(spark, base)[1].deleteOnExit(_at(spark, base)[0])
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/") if "://" in base or base.startswith("file:") else "file://" + base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder, deleted with the scratch that is open, and when the JVM ends at the latest."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    where, files = _at(spark, path)
    files.deleteOnExit(where)
    if (s := _now.get()) is not None:
        s.paths[path] = spark
    return path


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    where, files = _at(spark, path)
    files.delete(where, True)
    files.cancelDeleteOnExit(where)


#: Spark's setting that drops the shuffle files of a query once it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: ends its lineage, and computes it once.

    The shuffle files of the write go when it ends, for nothing reads them again.
    """
    spark = df.sparkSession
    path, was = new_path(spark, label), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, was) if was is not None else spark.conf.unset(_CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    out._concord_path = path
    return out


#: Bytes of a task at most: of a table's file, and of what a task reads from a shuffle.
TASK_BYTES = 16 << 20
_SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def small_tasks(spark: SparkSession) -> None:
    """Lower the bytes of a task where they are larger: packed columns of numbers unfold to twenty times as much when they are sorted."""
    for key in _SPLITS:
        number, unit = re.fullmatch(r"(\d+)([a-z]?)[a-z]*", spark.conf.get(key).lower()).groups()
        if int(number) << 10 * "bkmgtp".index(unit or "b") > TASK_BYTES:
            spark.conf.set(key, str(TASK_BYTES))
