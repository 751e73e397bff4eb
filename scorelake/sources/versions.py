"""Tables that change together: new files first, then one pointer, and readers bound to a version.

A folder holds a group of tables. A table is kept in hash buckets of its key, each in a folder of its own, written once and never changed. A version is a small
manifest, ``_versions/<number>.json``, that names the folder of every bucket of every table. A commit writes the buckets it changes to new folders, and last
the next manifest, under a name that no one else can take: until then nobody sees any of it, after it everybody sees all of it. A writer that was overtaken
finds the number taken and fails without a trace in any table. A reader names a version, or takes the newest, and keeps reading the same files whatever is committed meanwhile.

What a killed commit leaves behind is in no manifest; :func:`vacuum` removes it together with versions that are no longer wanted.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class CommitConflict(RuntimeError):
    """Another commit took the version number first."""


@dataclass(frozen=True)
class TableState:
    """A table in one version: its key, number of buckets, schema, and the folder of each bucket that has rows."""

    key: str
    buckets: int
    schema: str
    folders: dict[int, str] = field(default_factory=dict)


class _Files:
    """The folder's file system, through Hadoop: any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.path = lambda *parts: self.jvm.org.apache.hadoop.fs.Path("/".join((root, *parts)))
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())
        self.conf = spark._jsc.hadoopConfiguration()

    def names(self, *parts: str) -> list[str]:
        where = self.path(*parts)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, *parts: str) -> bool:
        """Whole content under a new name, or nothing: false where the name is taken."""
        target, draft = self.path(*parts), self.path(*parts[:-1], f".{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            context.rename(draft, target, self.gateway.new_array(kind, 0))
            return True
        except Exception as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)


class TableGroup:
    """The tables under ``root``, as versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.files = _Files(spark, root)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("_versions") if n.endswith(".json") and not n.startswith(".")]

    def newest(self) -> int:
        """The last committed version, 0 before the first."""
        return max(self.versions(), default=0)

    def states(self, version: int | None = None) -> dict[str, TableState]:
        version = self.newest() if version is None else version
        if not version:
            return {}
        raw = json.loads(self.files.read("_versions", f"{version:012d}.json"))
        return {name: TableState(t["key"], t["buckets"], t["schema"], {int(b): f for b, f in t["folders"].items()}) for name, t in raw["tables"].items()}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as a version has it; the files are fixed when this is called."""
        state = self.states(version)[table]
        return self._bucketed(table, state, list(state.folders)).drop("bucket")

    def _bucketed(self, table: str, state: TableState, buckets: list[int]) -> DataFrame:
        schema = T.StructType.fromDDL(state.schema)
        wanted = [f"{self.root}/{table}/{state.folders[b]}" for b in buckets if b in state.folders]
        stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(stored).parquet(*wanted) if wanted else self.spark.createDataFrame([], stored)

    def replace(self, changes: dict[str, tuple[DataFrame, str, DataFrame | None]], buckets: int = BUCKETS, based_on: int | None = None) -> int:
        """Commits for each table ``(rows, key, replaced keys)``: stored rows go that have a key of ``rows`` or one of the replaced keys (one column, or None), ``rows`` come.

        All tables change in one version, whose number is returned. Only buckets that hold a replaced key are written. ``based_on`` is the version that the rows were made from;
        the commit fails with :class:`CommitConflict` if there is a newer one by the time it is made. A new table gets ``buckets``, an old one keeps its own.
        """
        base = self.newest() if based_on is None else based_on
        states, attempt = self.states(base), uuid.uuid4().hex
        for table, (rows, key, replaced) in changes.items():
            states[table] = self._written(table, states.get(table), rows, key, replaced, buckets, attempt)
        return self._commit(states, base)

    def rebucket(self, table: str, buckets: int) -> int:
        """The same rows in another number of buckets, as a version: for a table that has outgrown its buckets."""
        base = self.newest()
        states = self.states(base)
        state = states[table]
        states[table] = self._written(table, None, self.read(table, base), state.key, None, buckets, uuid.uuid4().hex)
        return self._commit(states, base)

    def _written(self, table: str, state: TableState | None, rows: DataFrame, key: str, replaced: DataFrame | None, buckets: int, attempt: str) -> TableState:
        if state and state.key != key:
            raise ValueError(f"{table} is kept by {state.key}, not {key}")
        buckets = state.buckets if state else buckets
        schema = rows.schema.toDDL() if not state else state.schema
        dealt = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        fresh, touched = rows.select(*T.StructType.fromDDL(schema).fieldNames()).withColumn("bucket", dealt), []
        if state:
            gone = rows.select(key).distinct()
            if replaced is not None:
                gone = gone.union(replaced.toDF(key)).distinct()
            touched = sorted(row["bucket"] for row in gone.select(dealt.alias("bucket")).distinct().collect())
            # Null keys are replaced by null keys.
            left, right = self._bucketed(table, state, touched), gone.toDF("_gone")
            fresh = left.join(right, F.col(key).eqNullSafe(F.col("_gone")), "left_anti").unionByName(fresh)
        folder = f"{self.root}/{table}/{attempt}"
        # Few files a bucket, and a bucket with a dominant key is split over tasks.
        fresh.withColumn("part", F.col("bucket")).hint("rebalance", F.col("bucket")).write.partitionBy("part").parquet(folder)
        names = [n for n in self.files.names(table, attempt) if n.startswith("part=")]
        new = {int(n[5:]): f"{attempt}/{n}" for n in names}
        kept = {b: f for b, f in (state.folders if state else {}).items() if b not in touched}
        return TableState(key, buckets, schema, {**kept, **new})

    def _commit(self, states: dict[str, TableState], base: int) -> int:
        version = base + 1
        tables = {name: {"key": s.key, "buckets": s.buckets, "schema": s.schema, "folders": s.folders} for name, s in states.items()}
        self.files.fs.mkdirs(self.files.path("_versions"))
        if self.newest() != base or not self.files.publish(json.dumps({"tables": tables}, indent=1), "_versions", f"{version:012d}.json"):
            raise CommitConflict(f"version {version} was committed by another writer")
        return version

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes all but the newest ``keep`` versions and the files that none of those names; not to be run beside a commit. The removed folders are returned."""
        versions = self.versions()
        for old in versions[:-keep]:
            self.files.delete("_versions", f"{old:012d}.json")
        states = [self.states(v) for v in versions[-keep:]]
        removed = []
        for table in (n for n in self.files.names() if n != "_versions"):
            named = {f for s in states if table in s for f in s[table].folders.values()}
            for attempt in self.files.names(table):
                for bucket in self.files.names(table, attempt):
                    if f"{attempt}/{bucket}" not in named:
                        self.files.delete(table, attempt, bucket)
                        removed.append(f"{table}/{attempt}/{bucket}")
                if not self.files.names(table, attempt):
                    self.files.delete(table, attempt)
        return removed
