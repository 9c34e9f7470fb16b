import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillweave.llm import mixing, queries
from tests.oracle_check import connect, differences, duck_rows, spark_rows

DIRECTORY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_matches_sql(spark, name):
    names, rows = spark_rows(queries.QUERIES[name](spark, DIRECTORY))
    duck_names, expected = duck_rows(connect(DIRECTORY), queries.ORACLES[name])
    assert names == duck_names and len(rows) == len(expected)
    assert not differences(rows, expected)


def filled(sizes, weights, cap):
    """Targets by repeated dealing out, for comparison."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = {s: weight[s] for s in order if s not in capped}
        level = rest / sum(free.values()) if free else 0
        over = [s for s in free if level * free[s] > cap * sizes[s]]
        if not over:
            return {**capped, **{s: level * w for s, w in free.items()}}
        for s in over:
            capped[s] = float(cap * sizes[s])


def test_budgets_caps_and_odd_rows(odd):
    rows = mixing.mix(odd, weights=(1, 2, 3)).collect()
    assert len(rows) == odd.count()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    assert sum(sizes.values()) == sum(len((r["text"] or "").split()) for r in odd.collect())
    wanted = filled(sizes, (1, 2, 3), 3)
    for source, size in sizes.items():
        own = [r for r in rows if r["source"] == source]
        assert {r["source_size"] for r in own} == {size}
        assert own[0]["target"] == pytest.approx(wanted[source])
        # equal rows share the last words evenly, so fewer than one each may be left
        assert 0 <= math.floor(wanted[source]) - sum(r["taken"] for r in own) < 2
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)


def test_hot_source_spreads_and_is_exact(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 17 + 1).cast("int")).alias("text"),
    )
    rows = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(taken[s] == math.floor(target[s] + 1e-9) for s in target)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_mixed_documents_repeat_whole_rows(odd):
    plan = Counter()
    for r in mixing.mix(odd).select("doc_id", "source", "size", "whole_copies").collect():
        plan[r["doc_id"]] += r["whole_copies"]
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +plan


def test_empty(empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
