"""Partitioned tables whose rewrites are atomic.

A table is a folder with `data`, one sub-folder per write, and `versions`, one small JSON file per version, which lists the folder of every
partition. A write first stores its partitions next to the old ones; the new version counts from the moment its file gets its name, and a
name is given once. Readers take the newest version (or a given one), so they never see half a write, and a writer that dies leaves the table
as it was. Two writers at once cannot both make the same version; the later one starts again from the version it lost to.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from py4j.protocol import Py4JJavaError

PART = "_part"
TRIES = 5


class Conflict(Exception):
    """Another writer made the version first."""


@dataclass(frozen=True)
class Version:
    """One state of a table: its number, schema, partition column, and the folder of every partition."""

    number: int
    schema: str
    partition_by: str
    folders: dict[str, str] = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = jvm.Path(self.root).getFileSystem(self._conf)

    # versions

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def numbers(self) -> list[int]:
        """The versions that can be read, oldest first."""
        return [int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and not n.startswith((".", "_"))]

    def version(self, number: int | None = None) -> Version | None:
        """A version, the newest if none is named; None for a table not yet made."""
        if number is None:
            made = self.numbers()
            if not made:
                return None
            number = made[-1]
        stream = self._fs.open(self._path(self._file(number)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def _file(self, number: int) -> str:
        return f"{self.root}/versions/{number:012d}.json"

    def _commit(self, new: Version) -> Version:
        draft = self._path(f"{self.root}/versions/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(json.dumps(asdict(new)).encode())
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        rename = getattr(jvm, "Options$Rename")
        once = self.spark.sparkContext._gateway.new_array(rename, 1)
        once[0] = rename.NONE
        context = jvm.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._path(self._file(new.number))), once)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                self._fs.delete(draft, False)
                raise Conflict(f"version {new.number} of {self.root}") from e
            raise
        return new

    # reading

    def _read(self, version: Version, names: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(version.schema))
        folders = [f"{self.root}/{version.folders[n]}" for n in names if n in version.folders]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*folders)

    def read(self, number: int | None = None, partitions: list | None = None) -> DataFrame:
        """The rows of a version, the newest by default; of these partition values only, if given."""
        version = self.version(number)
        if version is None:
            raise FileNotFoundError(f"no table at {self.root}")
        return self._read(version, sorted(version.folders) if partitions is None else [self._name(p) for p in partitions])

    # writing

    def _name(self, value) -> str:
        """Folder of a partition value, as Spark names it."""
        text = None if value is None else str(value)
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(PART, text)

    def _store(self, df: DataFrame, partition_by: str) -> dict[str, str]:
        """Write rows into a new data folder; the folder of every partition that has some."""
        folder = f"data/{uuid.uuid4().hex}"
        df.withColumn(PART, F.col(partition_by).cast("string")).write.partitionBy(PART).parquet(f"{self.root}/{folder}")
        return {n: f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{PART}=")}

    def create(self, df: DataFrame, partition_by: str) -> Version:
        """The first version of a table, or a wholly new content as the next one."""
        last = self.version()
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]).json()
        return self._commit(Version(0 if last is None else last.number + 1, schema, partition_by, self._store(df, partition_by)))

    def rewrite(self, touched: list, change) -> Version:
        """A new version in which `change(rows of the touched partitions)` takes the place of those partitions.

        Lost to another writer, it is done again on that writer's version.
        """
        names = [self._name(v) for v in touched]
        for left in range(TRIES - 1, -1, -1):
            old = self.version()
            schema = T.StructType.fromJson(json.loads(old.schema))
            made = self._store(change(self._read(old, names)).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), old.partition_by)
            stray = sorted(set(made) - set(names))
            if stray:
                raise ValueError(f"rows left their partitions for {stray}")
            folders = {n: f for n, f in old.folders.items() if n not in names} | made
            try:
                return self._commit(Version(old.number + 1, old.schema, old.partition_by, folders))
            except Conflict:
                if not left:
                    raise

    def upsert(self, updates: DataFrame, keys: list[str]) -> Version:
        """Rows of the updates' keys replaced, new keys appended; only the partitions that the updates touch are written.

        ``updates`` hold one row per key, in the partition of the row they replace. Done twice, it gives the same rows.
        """
        by = self.version().partition_by
        touched = [r[0] for r in updates.select(F.col(by).cast("string")).distinct().collect()]
        return self.rewrite(touched, lambda rows: rows.join(updates.select(*keys), keys, "left_anti").unionByName(updates.select(rows.columns)))

    # clearing

    def expire(self, keep: int = 2) -> int:
        """Forget all but the newest versions and delete the data that only those had; returns the number of folders deleted."""
        made = self.numbers()
        old, kept = made[:-keep], made[-keep:]
        used = {f for n in kept for f in self.version(n).folders.values()}
        gone = {f for n in old for f in self.version(n).folders.values()} - used
        for number in old:
            self._fs.delete(self._path(self._file(number)), False)
        for folder in gone:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        return len(gone)
