"""What the text operators share: word pattern, written intermediates, and a deterministic split of documents."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.sources.staging import shared_root, staged_path

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tillweave-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session, whose tasks all run here, may lack it and gets a temporary
    one; a cluster has to name one."""
    root = shared_root(spark)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_folder()


def new_path(spark: SparkSession, name: str) -> str:
    return staged_path(shared_folder(spark), name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, a known size, safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    return df.sparkSession.read.schema(nullable).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> SparkSession:
    """Hand texts to Python in smaller batches than by default (10,000 rows), so that long ones fit a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``: a split that needs no state. A null id counts as empty text."""
    return (F.crc32(id_text(doc_id).cast("binary")) % modulus).cast("int")


def hash_sample(rows: DataFrame, by: str, key: str, most: Column, slices: int = 1_024) -> DataFrame:
    """At most ``most`` (a column over ``by``) distinct keys of each group: those of smallest hash (``by``, ``key``).

    Groups' sizes give each a first cut by hash that leaves about four times as many. What is left is counted by slices of
    the hash's range; the sums of these counts, ``slices`` a group, tell which slices are taken whole, and only the keys of
    the one slice in which a group's sample ends are ranked.
    """
    ids = rows.select(by, key).distinct()
    sizes = written(ids.groupBy(by).agg(F.count(F.lit(1)).alias("group_size")).withColumn("most", most), "sample-sizes")
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    share = place * F.col("group_size") / (F.lit(1 << 30) * (4.0 * F.col("most") + 100))
    near = ids.join(sizes, by).withColumn("share", share).where("share < 1")
    near = written(near.select(by, key, "most", place.alias("place"), F.floor(F.col("share") * slices).alias("slice")), "sample-near")
    upto = F.sum("slice_rows").over(Window.partitionBy(by).orderBy("slice"))
    ends = near.groupBy(by, "slice").agg(F.count(F.lit(1)).alias("slice_rows")).withColumn("upto", upto)
    found = near.join(ends, [by, "slice"]).withColumn("before", F.col("upto") - F.col("slice_rows"))
    whole = found.where(F.col("upto") <= F.col("most"))
    last = found.where((F.col("before") < F.col("most")) & (F.col("upto") > F.col("most")))
    ranked = last.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy("place", key)))
    return whole.select(by, key).unionByName(ranked.where(F.col("before") + F.col("turn") <= F.col("most")).select(by, key))


def few(df: DataFrame, most: int = 4_000_000) -> DataFrame:
    """A written table of short rows, marked for broadcasting if it has at most ``most`` rows; a plain join takes it beyond."""
    return F.broadcast(df) if df.count() <= most else df
