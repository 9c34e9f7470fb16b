from pyspark.sql import functions as F

from tillweave.llm import tables


def test_hash_sample_takes_the_smallest_hashes(spark):
    """Of a large, a small and a tiny group, with repeated rows, whatever the number of slices."""
    group = F.when(F.col("id") < 9_000, "large").when(F.col("id") < 9_300, "small").otherwise("tiny")
    rows = spark.range(9_310).select(group.alias("g"), F.col("id").alias("key"))
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 30)).alias("place")
    ordered = sorted((r["place"], r["key"], r["g"]) for r in rows.select("g", "key", place).collect())
    for most, slices in ((1, 1_024), (100, 1), (100, 1_024), (2_500, 7)):
        expected = {(g, k) for name in ("large", "small", "tiny") for _, k, g in [r for r in ordered if r[2] == name][:most]}
        got = tables.hash_sample(rows.union(rows.limit(50)), "g", "key", F.lit(most), slices).collect()
        assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    assert tables.hash_sample(rows.limit(0), "g", "key", F.lit(3)).count() == 0
