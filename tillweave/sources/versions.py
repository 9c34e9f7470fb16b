"""Parquet tables that are replaced in whole, by partition or by key, and read in one consistent version.

A table is a folder with data files, laid out as ``data/<by>=<value>/run=<id>/``, and numbered versions. A version says which
run's files are current in each partition. A change first writes its own run's files, reads its version back, and only then
moves the version into place, in one rename that fails if another writer was first. So a failed attempt leaves readers at the
last version, unchanged partitions keep their files, and an older version can still be read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.sources.staging import stage

_RUN = "run"


class TableChanged(RuntimeError):
    """Another writer put its version in place first; the change can be tried again."""


class VersionedTable:
    """A table in the folder ``root``, partitioned by the columns ``by`` (none: replaced in whole only).

    The folder has to be on a file system whose renames are atomic (HDFS, a local disk). Column ``run`` is the table's own.
    """

    def __init__(self, spark: SparkSession, root: str, by: Sequence[str] = ()):
        self.spark, self.root, self.by = spark, root.rstrip("/"), list(by)

    # ---- versions ----

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        """Numbers of the complete versions, ascending; none if the table was never written."""
        folder = self._path(f"{self.root}/versions")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _schema(self, version: int) -> T.StructType:
        text = self.spark.read.text(f"{self.root}/versions/{version}/schema").first()[0]
        return T.StructType.fromJson(json.loads(text))

    def _parts(self, version: int) -> DataFrame:
        """Current run of each partition."""
        schema = self._schema(version)
        kept = T.StructType([schema[c] for c in self.by] + [T.StructField(_RUN, T.StringType())])
        return self.spark.read.schema(kept).parquet(f"{self.root}/versions/{version}/parts")

    def _swap(self, parts: DataFrame, schema: T.StructType, after: int) -> int:
        """Write a version, check that it can be read, and move it into place as the one after ``after``."""
        draft = f"{self.root}/versions/draft-{uuid.uuid4().hex}"
        parts.write.parquet(f"{draft}/parts")
        self.spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.text(f"{draft}/schema")
        kept = T.StructType([schema[c] for c in self.by] + [T.StructField(_RUN, T.StringType())])
        written = self.spark.read.schema(kept).parquet(f"{draft}/parts")
        self._current(schema, written).limit(1).collect()
        jvm, target = self.spark._jvm, self._path(f"{self.root}/versions/{after + 1}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(draft), target, options)
        except Exception as error:
            if (after + 1) in self.versions():
                raise TableChanged(f"version {after + 1} of {self.root} exists") from error
            raise
        return after + 1

    # ---- reading ----

    def _files(self, schema: T.StructType) -> DataFrame:
        """Rows of all runs, also of those that no version names."""
        nullable = [T.StructField(f.name, f.dataType, True) for f in schema]
        return self.spark.read.schema(T.StructType([*nullable, T.StructField(_RUN, T.StringType())])).parquet(f"{self.root}/data")

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of the last version, or of an older one."""
        if version is None:
            if not self.versions():
                raise FileNotFoundError(f"no version of {self.root}")
            version = self.versions()[-1]
        schema = self._schema(version)
        return self._current(schema, self._parts(version)).select(*schema.names)

    def _current(self, schema: T.StructType, parts: DataFrame) -> DataFrame:
        """Rows of the named partitions' current runs; the scan skips all other folders."""
        rows, named = self._files(schema).alias("rows"), parts.alias("named")
        same = F.col(f"rows.{_RUN}") == F.col(f"named.{_RUN}")
        for column in self.by:
            same = same & F.col(f"rows.{column}").eqNullSafe(F.col(f"named.{column}"))
        return rows.join(named, same, "left_semi")

    # ---- writing ----

    def _write(self, df: DataFrame) -> DataFrame:
        """Write rows as a run of their own; the partitions it has."""
        run = uuid.uuid4().hex
        rows = df.hint("rebalance", *self.by) if self.by else df.hint("rebalance")  # large partitions are split, small ones share a file
        rows.withColumn(_RUN, F.lit(run)).write.mode("append").partitionBy(*self.by, _RUN).parquet(f"{self.root}/data")
        return self._files(df.schema).where(F.col(_RUN) == run).select(*self.by, _RUN).distinct()

    def _checked(self, df: DataFrame) -> None:
        if _RUN in df.columns:
            raise ValueError(f"a column is named {_RUN}")
        missing = [c for c in self.by if c not in df.columns]
        if missing:
            raise ValueError(f"no column {missing[0]} to partition by")

    def replace(self, df: DataFrame) -> int:
        """Make ``df`` the table's whole content; partitions it lacks are gone. Returns the new version's number."""
        self._checked(df)
        after = max(self.versions(), default=0)
        parts = self._write(df)
        return self._swap(parts, df.schema, after)

    def replace_partitions(self, df: DataFrame) -> int:
        """Replace the partitions that ``df`` has rows of, with these rows; all others keep their files."""
        self._checked(df)
        after, schema = self._last(df)
        parts = self._write(df.select(*schema.names))
        return self._swap(self._others(after, parts).unionByName(parts), schema, after)

    def merge(self, changes: DataFrame, keys: Sequence[str], *, deleted: str | None = None) -> int:
        """Insert or update rows by ``keys``; rows whose flag ``deleted`` is true are removed. Repeating it changes nothing.

        Only partitions that hold a changed key, or get one, are written again: an updated row may move to another partition.
        Rows with a NULL in a key match nothing and are added. ``changes`` must name a key once.
        """
        self._checked(changes)
        after, schema = self._last(changes.drop(deleted) if deleted else changes)
        complete = changes.dropna(subset=list(keys))
        if not complete.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"changes name a key {tuple(keys)} more than once")
        current = self._current(schema, self._parts(after))
        upserts = changes.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else changes
        hit = current.join(complete.select(*keys), list(keys), "left_semi").select(*self.by)
        # one row per touched partition: found once, and handed to the tasks, or the join would gather a partition's rows in one of them
        touched = F.broadcast(stage(hit.unionByName(upserts.select(*self.by)).distinct(), "touched-partitions")) if self.by else hit
        old = current
        if self.by:
            old, part = current.alias("old"), touched.alias("part")
            same = F.lit(True)
            for column in self.by:
                same = same & F.col(f"old.{column}").eqNullSafe(F.col(f"part.{column}"))
            old = old.join(part, same, "left_semi")
        kept = old.join(complete.select(*keys), list(keys), "left_anti").select(*schema.names)
        parts = self._write(kept.unionByName(upserts.select(*schema.names)))
        if not self.by:
            return self._swap(parts, schema, after)
        return self._swap(self._others(after, touched).unionByName(parts), schema, after)

    def _last(self, df: DataFrame) -> tuple[int, T.StructType]:
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"no version of {self.root}")
        schema = self._schema(versions[-1])
        kinds = {f.name: f.dataType for f in df.schema}
        if kinds != {f.name: f.dataType for f in schema}:
            raise ValueError(f"columns {df.schema.simpleString()} differ from the table's {schema.simpleString()}")
        return versions[-1], schema

    def _others(self, version: int, parts: DataFrame) -> DataFrame:
        """Current partitions but those of ``parts``."""
        named, gone = self._parts(version).alias("named"), parts.alias("gone")
        if not self.by:
            return named.limit(0)
        same = F.lit(True)
        for column in self.by:
            same = same & F.col(f"named.{column}").eqNullSafe(F.col(f"gone.{column}"))
        return named.join(gone, same, "left_anti")
