"""Reading input tables by logical name and writing results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


class TableBook:
    """Logical table name -> DataFrame.

    Names are bound to Parquet paths or catalog tables; names that are not bound are looked up as
    ``<directory>/<name>.parquet``.
    """

    def __init__(
        self,
        spark: SparkSession,
        directory: str | None = None,
        *,
        paths: Mapping[str, str] | None = None,
        catalog: Mapping[str, str] | None = None,
    ):
        self.spark = spark
        self._directory = directory
        self._paths = dict(paths or {})
        self._catalog = dict(catalog or {})
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._open(name)
        return self._opened[name]

    def _open(self, name: str) -> DataFrame:
        if name in self._catalog:
            return self.spark.table(self._catalog[name])
        if name in self._paths:
            return self._read(self._paths[name])
        if self._directory is None:
            raise KeyError(name)
        return self._read(f"{self._directory}/{name}.parquet")

    def _read(self, path: str) -> DataFrame:
        """Read Parquet; its schema is looked up in the files once per book."""
        return self.spark.read.parquet(path)


def replace_table(df: DataFrame, table: str) -> None:
    """Create or fully replace a catalog table with a result."""
    df.write.mode("overwrite").format("parquet").saveAsTable(table)


def replace_files(df: DataFrame, path: str) -> None:
    """Create or fully replace a Parquet folder with a result."""
    df.write.mode("overwrite").parquet(path)
