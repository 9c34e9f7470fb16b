"""Runtime settings the operators count on. Only SQL settings of the given session are touched."""

from __future__ import annotations

from pyspark.sql import SparkSession

# A join on a hot key is split by adaptive execution only if the step after it shuffles anyway. By default an aggregation
# on more columns than the join's keys reuses the join's partitioning, which leaves a hot article, store or customer in one
# task; asking for all grouping keys puts a (map-side combined) shuffle there and makes the split possible.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.requireAllClusterKeysForDistribution": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
