"""Which source files a stored table was made of, so that later only new ones are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "source string, path string, length long, modified timestamp, part long"
_FILE = ["source", "path", "length", "modified"]


def files_of(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """``(source, path, length, modified)``: the Parquet files of each named source, a file or a folder; contents are not read."""
    found = None
    for name, path in sources.items():
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
        rows = listed.select(F.lit(name).alias("source"), "path", "length", F.col("modificationTime").alias("modified"))
        found = rows if found is None else found.unionByName(rows)
    return found


class GrowingTable:
    """Tables made from source files, part by part, in ``folder``: each file is read once.

    ``derive`` gets the new files' rows per source (None for a source without any) and returns the named tables' rows to add, so
    it must be additive: the tables of two sets of files are those of their union.  A part is written before it enters the
    manifest, and overwritten if that never happened.  If a file changed or vanished, everything is made anew, in a new generation.
    """

    def __init__(
        self,
        spark: SparkSession,
        sources: dict[str, str],
        folder: str,
        derive: Callable[[dict[str, DataFrame | None]], dict[str, DataFrame]],
    ):
        self.spark, self.sources, self.folder, self.derive = spark, sources, folder, derive

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _generation(self) -> int:
        g = 0
        while self._exists(f"{self.folder}/generation={g + 1}/manifest"):
            g += 1
        return g

    def manifest(self, generation: int | None = None) -> DataFrame:
        """The files that are in the tables, with the part each is in."""
        path = f"{self.folder}/generation={self._generation() if generation is None else generation}/manifest"
        if not self._exists(path):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(path)

    def refresh(self) -> list[str]:
        """Take in the files that are new; their paths.  What is listed on the driver is one entry per file."""
        generation = self._generation()
        listed, known = files_of(self.spark, self.sources).collect(), self.manifest(generation).collect()
        have = {tuple(r[c] for c in _FILE) for r in known}
        now = {tuple(r[c] for c in _FILE) for r in listed}
        if have - now:
            generation, have, known = generation + 1, set(), []
        new = sorted(now - have)
        if new:
            part = max((r.part for r in known), default=-1) + 1
            paths = {name: [path for source, path, *_ in new if source == name] for name in self.sources}
            rows = {name: self.spark.read.parquet(*some) if some else None for name, some in paths.items()}
            base = f"{self.folder}/generation={generation}"
            for name, table in self.derive(rows).items():
                table.write.mode("overwrite").parquet(f"{base}/{name}/part={part}")
            entries = self.spark.createDataFrame([(*f, part) for f in new], MANIFEST)
            entries.drop("part").coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest/part={part}")
        return [path for _, path, *_ in new]

    def table(self, name: str) -> DataFrame:
        """One of the tables, of all parts in the manifest."""
        generation = self._generation()
        parts = [r.part for r in self.manifest(generation).select("part").distinct().collect()]
        if not parts:
            raise ValueError("nothing is stored yet: call refresh()")
        return self.spark.read.parquet(*[f"{self.folder}/generation={generation}/{name}/part={n}" for n in sorted(parts)])

    def derived(self, name: str, source: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A table made of ``source`` by ``make``, which must be additive: part by part, each on first use, of all parts in the manifest."""
        generation = self._generation()
        base = f"{self.folder}/generation={generation}"
        parts = sorted(r.part for r in self.manifest(generation).select("part").distinct().collect())
        if not parts:
            raise ValueError("nothing is stored yet: call refresh()")
        for n in parts:
            if not self._exists(f"{base}/{name}/part={n}/_SUCCESS"):
                made = make(self.spark.read.parquet(f"{base}/{source}/part={n}"))
                made.write.mode("overwrite").parquet(f"{base}/{name}/part={n}")
        return self.spark.read.parquet(*[f"{base}/{name}/part={n}" for n in parts])
