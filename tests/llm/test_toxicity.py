import random

import pytest
from pyspark.sql import functions as F

from tillweave.llm import queries, toxicity

SCHEMA = "doc_id long, text string, size int, score string"


def corpus(n=700):
    rng = random.Random(4)
    common = ["".join(rng.choice(["an", "er", "th", "in", "on", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    foul = ["grumbleskunk", "dirtwit", "slimefool"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randrange(30, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(3, len(words) // 20)):
                words.insert(rng.randrange(len(words)), rng.choice(foul))
        rows.append((i, " ".join(words), 1, "s"))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents(tables):
    docs, labels = tables
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.score_toxicity(docs, labels, learn=F.col("doc_id") % 3 != 0).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["doc_id"] % 3 == 0]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    kept = toxicity.keep_ordinary(docs, labels, learn=F.col("doc_id") % 3 != 0)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["predicted"] == 0}


def test_query_runs_on_every_document(spark, documents):
    rows = queries.op10_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in documents.collect()} and len(rows) == documents.count()


def test_odd_rows(spark, odd, empty, tables):
    labels = spark.createDataFrame([(1, 1), (7, 0), (7, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd, labels, learn=F.lit(True)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}
    assert len(blank) == 1
    none = toxicity.score_toxicity(odd, labels.where("toxic = 0"), learn=F.lit(True)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.score_toxicity(empty, labels, learn=F.lit(True)).count() == 0
