"""Partitioned tables by manifests: which files a table consists of is itself a small table, so partitions come, go and are kept
aside without a file being moved. A file is freed once no manifest names it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "file string, part string"


class ManifestTable:
    """A table under a folder: `data` has its files, `now/<number>` what it consists of at each change, `frozen/<name>` what was kept aside.

    A change is one manifest, written whole under the next number: readers see the one before or the one after. One writer at a
    time. Manifests have a row for each file, which the driver lists in any read.
    """

    def __init__(self, spark: SparkSession, path: str, by: str):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self.root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        found = self.fs.listStatus(at) if self.fs.exists(at) else []
        return [s.getPath().getName() for s in found if self.fs.exists(self._at(folder, s.getPath().getName(), "_SUCCESS"))]

    def _manifest(self, folder: str, name: str) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(f"{self.path}/{folder}/{name}")

    def version(self) -> int:
        return max((int(n) for n in self._names("now")), default=0)

    def files(self) -> DataFrame:
        """(file, part) of the table as it is."""
        version = self.version()
        return self._manifest("now", str(version)) if version else self.spark.createDataFrame([], FILES)

    def _change(self, files: DataFrame) -> None:
        files.coalesce(1).write.parquet(f"{self.path}/now/{self.version() + 1}")

    def _stored(self, rows: DataFrame) -> DataFrame:
        """(file, part) of rows, once they are written."""
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.withColumn("__part", F.coalesce(F.col(self.by).cast("string"), F.lit(""))).repartition("__part").write.partitionBy("__part").parquet(at)
        told = self.spark.read.schema("__part string").option("basePath", at).parquet(at) if self._has_files(at) else None
        if told is None:
            return self.spark.createDataFrame([], FILES)
        return told.select(F.col("_metadata.file_path").alias("file"), F.coalesce("__part", F.lit("")).alias("part")).distinct()

    def _has_files(self, at: str) -> bool:
        return any(s.isDirectory() for s in self.fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(at)))

    def append(self, rows: DataFrame) -> None:
        self._change(self.files().unionByName(self._stored(rows)))

    def replace_partition(self, part: str, rows: DataFrame) -> None:
        """The partition's rows are those of rows that belong to it; others are an error when they are read."""
        mine = F.assert_true(F.coalesce(F.col(self.by).cast("string"), F.lit("")) == part, f"not of partition {part}").isNull()
        self._change(self.files().where(F.col("part") != part).unionByName(self._stored(rows.where(mine))))

    def drop_partition(self, part: str) -> None:
        self._change(self.files().where(F.col("part") != part))

    def freeze(self, name: str, part: str | None = None) -> None:
        """Keeps the table, or a partition of it, aside as it is now: its files stay, whatever becomes of the table."""
        files = self.files() if part is None else self.files().where(F.col("part") == part)
        files.coalesce(1).write.parquet(f"{self.path}/frozen/{name}")

    def unfreeze(self, name: str) -> None:
        if not self.fs.delete(self._at("frozen", name), True):
            raise ValueError(f"nothing is frozen as {name}")

    def read(self, frozen: str | None = None) -> DataFrame:
        """The table's rows, or those kept aside under a name. A table without files has no schema, and is an error."""
        files = [r.file for r in (self.files() if frozen is None else self._manifest("frozen", frozen)).select("file").collect()]
        if not files:
            raise ValueError("no rows are stored")
        return self.spark.read.parquet(*files)

    def unnamed(self) -> DataFrame:
        """(file): stored files that neither the table as it is now nor anything frozen names."""
        stored = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.path}/data").select(F.col("path").alias("file"))
        named = self.files().select("file")
        for name in self._names("frozen"):
            named = named.unionByName(self._manifest("frozen", name).select("file"))
        plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
        return stored.join(named.select(plain("file").alias("of")).distinct(), plain("file") == F.col("of"), "left_anti")

    def free(self) -> int:
        """Deletes unnamed files and earlier manifests; how many files that were. Not while others read an earlier state."""
        gone = [r.file for r in self.unnamed().collect()]
        for file in gone:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(file), False)
        now = self.version()
        for name in self._names("now"):
            if int(name) < now:
                self.fs.delete(self._at("now", name), True)
        return len(gone)
