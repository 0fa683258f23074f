"""An import graph on disk, kept current by changes: only what a change touches is scanned, resolved and written.

Two tables, `files` (path, stamp, listed) and `edges`, are partitioned by a hash of the file's path. A change
scans the files whose content differs, resolves their imports and the imports of other files that the change may
have moved, and overwrites the partitions that hold a row to change, and no other. The edges are written before
the files that say they are done, so a change that was cut short is made again by repeating it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import paths as P
from concord.operators.resolve import is_source
from concord.operators.sources import stale_edges
from concord.plans.shared import cut, scratch
from concord.sources.scanner import scan_files
from concord.streaming.changes import latest

#: (imports(file, specifier), listing(path, listed)) -> imports with kind, target and pattern.
Resolver = Callable[[DataFrame, DataFrame], DataFrame]
#: Files that say how specifiers resolve; a change of one asks for every import again.
SETTINGS = ("tsconfig.json", "package.json", "pnpm-workspace.yaml", ".gitignore")
MISSES = ("relative", "paths", "workspace", "other")
EDGE = ("file", "place", "line", "form", "reexport", "specifier", "literal", "star", "names", "kind", "target", "pattern")


class GraphStore:
    """Where the graph is, in how many parts, and how its specifiers resolve. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, resolver: Resolver, parts: int = 64) -> None:
        self.spark, self.path, self.resolver, self.parts = spark, path.rstrip("/"), resolver, parts

    def _part(self, path: str) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.parts)).cast("int")

    def files(self) -> DataFrame:
        """path, stamp (a hash of the content), listed (a source)."""
        return self.spark.read.parquet(f"{self.path}/files").where("path is not null").drop("part")

    def edges(self) -> DataFrame:
        """A row for each import: file, place and line, what it says, and kind, target and pattern of what it means."""
        return self.spark.read.parquet(f"{self.path}/edges").where("file is not null").drop("part")

    def _write(self, rows: DataFrame, key: str, table: str, touched: DataFrame | None) -> None:
        """All parts, or those touched(part): a row without a key keeps a part that would be empty."""
        rows = rows.withColumn("part", self._part(key))
        if touched is not None:
            # a partition that no row falls into is left as it is, so each touched one gets a row that nobody reads
            rows = rows.unionByName(touched.select("part"), allowMissingColumns=True)
        rows.repartition("part").write.option("partitionOverwriteMode", "dynamic" if touched is not None else "static").partitionBy("part").mode("overwrite").parquet(f"{self.path}/{table}")

    def _scanned(self, files: DataFrame) -> DataFrame:
        """Imports of sources(path, text), not resolved yet."""
        s = scan_files(files.where(is_source(F.col("path"))))
        place = F.posexplode("all").alias("place", "x")
        every = s.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "kind", "reexport", "specifier", "literal", "star", "names"))).alias("all"))
        return every.select(F.col("path").alias("file"), place).select("file", "place", "x.line", F.col("x.kind").alias("form"), "x.reexport", "x.specifier", "x.literal", "x.star", "x.names")

    def _resolved(self, imports: DataFrame, listing: DataFrame) -> DataFrame:
        asked = imports.where("literal").select("file", "specifier").distinct()
        answers = self.resolver(asked, listing).select("file", "specifier", "kind", "target", "pattern")
        out = imports.join(answers, ["file", "specifier"], "left")
        return out.withColumn("kind", F.when(F.col("literal"), F.col("kind")).otherwise("dynamic")).select(*EDGE)

    @staticmethod
    def _stamped(files: DataFrame) -> DataFrame:
        return files.select("path", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("stamp"), is_source(F.col("path")).alias("listed"))

    def build(self, files: DataFrame) -> None:
        """From files(path, text), all of them: sources and, for what is there but not listed, others."""
        with scratch():
            files = cut(self._stamped(files.where("path is not null").dropDuplicates(["path"])), "graph-files")
            self._write(self._resolved(self._scanned(files), files.select("path", "listed")), "file", "edges", None)
            self._write(files.drop("text"), "path", "files", None)

    def apply(self, changes: DataFrame, order: str = "seq") -> dict[str, int]:
        """changes(path, text, deleted, and an order): the last of each path counts. Returns how many files came, went and changed, imports were asked again, and parts written.

        Files whose content is as it was, and files to delete that are not there, are no change; without one nothing is written.
        """
        with scratch():
            have = self.files()
            last = latest(changes.where("path is not null"), "path", order)
            now = self._stamped(last.where("not deleted")).join(have.select("path", F.col("stamp").alias("was")), "path", "left")
            now = cut(now.where("was is null or was <> stamp"), "graph-changed")
            gone = cut(last.where("deleted").select("path").join(have.select("path"), "path"), "graph-gone")
            came = now.where("was is null").select("path")
            counts = {"added": came.count(), "changed": now.where("was is not null").count(), "removed": gone.count(), "asked": 0, "parts": 0}
            if not any(counts.values()):
                return counts
            moved = now.select("path").unionByName(gone)
            names = cut(have.select("path", "listed").join(moved, "path", "left_anti").unionByName(now.select("path", "listed")), "graph-listing")
            kept = self.edges().join(moved.withColumnRenamed("path", "file"), "file", "left_anti")
            setup = moved.where(P.basename(F.col("path")).isin(*SETTINGS))
            asked = cut(kept.where("literal") if not setup.isEmpty() else self._stale(kept, came, gone), "graph-stale")
            counts["asked"] = asked.count()
            again = cut(self._resolved(asked.select(*EDGE[:9]), names), "graph-again")
            # of those asked, the ones that mean something else now
            what = ("kind", "target", "pattern")
            same = asked.select("file", "place", F.struct(*what).alias("before"))
            differ = cut(again.join(same, ["file", "place"]).where(~F.struct(*what).eqNullSafe(F.col("before"))).select(*EDGE), "graph-differ")
            fresh = cut(self._resolved(self._scanned(now), names), "graph-fresh")
            parts = cut(moved.select(self._part("path").alias("part")).unionByName(differ.select(self._part("file").alias("part"))).distinct(), "graph-parts")
            counts["parts"] = parts.count()
            stay = self.spark.read.parquet(f"{self.path}/edges").where("file is not null").join(parts, "part", "left_semi").drop("part")
            stay = stay.join(moved.withColumnRenamed("path", "file"), "file", "left_anti").join(differ.select("file", "place"), ["file", "place"], "left_anti")
            self._write(cut(stay.select(*EDGE).unionByName(differ).unionByName(fresh), "graph-edges"), "file", "edges", parts)
            own = cut(moved.select(self._part("path").alias("part")).distinct(), "graph-own")
            stay = self.spark.read.parquet(f"{self.path}/files").where("path is not null").join(own, "part", "left_semi").drop("part")
            stay = stay.join(moved, "path", "left_anti").unionByName(now.select("path", "stamp", "listed"))
            self._write(cut(stay, "graph-stamps"), "path", "files", own)
            return counts

    @staticmethod
    def _stale(kept: DataFrame, came: DataFrame, gone: DataFrame) -> DataFrame:
        """Imports of files that stay, which may mean something else now."""
        kind = F.when(F.col("kind").isin(*MISSES), "unresolved").when(F.col("kind").isin("builtin", "package"), "outside").otherwise(F.col("kind"))
        keys = ["file", "line", "specifier"]
        none = came.limit(0)
        by_name = stale_edges(kept.select(*keys, F.when(F.col("kind") == "file", F.col("target")).alias("target"), kind.alias("kind")), gone, came, none).select(*keys).distinct()
        # what was a package may be a folder now, or the other way round, and what was there unlisted may have gone
        folders = came.unionByName(gone).select(F.explode(F.split(P.dirname(F.col("path")), "/")).alias("first")).distinct()
        folder = kept.where("literal").withColumn("first", F.substring_index("specifier", "/", 1)).join(folders, "first", "left_semi").select(*keys)
        some = gone.limit(1).select(F.lit(True).alias("any"))
        miss = kept.where(F.col("literal") & F.col("kind").isin(*MISSES)).join(F.broadcast(some)).select(*keys)
        return kept.where("literal").join(by_name.unionByName(folder).unionByName(miss).distinct(), keys, "left_semi")

    def reconcile(self, files: DataFrame) -> dict[str, int]:
        """Repair what lost events left: files(path, text), all of them, against the store; their differences are applied as changes."""
        with scratch():
            files = files.where("path is not null").dropDuplicates(["path"])
            gone = self.files().select("path").join(files.select("path"), "path", "left_anti")
            changes = files.select("path", "text", F.lit(False).alias("deleted"), F.lit(0).alias("seq"))
            return self.apply(changes.unionByName(gone.select("path", F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted"), F.lit(0).alias("seq"))))

    def stream(self, changes: DataFrame, checkpoint: str, order: str = "seq"):
        """A query that applies a stream of changes, batch by batch; a batch made twice changes nothing the second time."""
        return changes.writeStream.foreachBatch(lambda batch, _: self.apply(batch, order)).option("checkpointLocation", checkpoint).outputMode("append")
