from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_near_dups import brute
from tillweave.llm import language, mixing, toxicity
from tillweave.llm.tables import id_remainder, written

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What goes into each stage and what comes out, written in between as the pipeline does."""
    docs, seen = spark.read.parquet(f"{DIRECTORY}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, DIRECTORY), f"test-{name}")
        seen.append((name, docs, out))
        docs = out
    return seen


def test_stages_keep_the_columns(steps):
    assert [n for n, _, _ in steps] == ["language", "toxicity", "near_copies", "mixing", "packing"]
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns


def test_language_and_toxicity_decide(spark, steps):
    _, before, after = steps[0]
    found = language.predict_language(before, learn=id_remainder(F.col("doc_id"), 4) != 2).collect()
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.5}
    _, before, after = steps[1]
    labels = spark.read.parquet(f"{DIRECTORY}/labels.parquet")
    found = toxicity.score_toxicity(before, labels, learn=id_remainder(F.col("doc_id"), 5) != 0).collect()
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in found if r["predicted"] == 0}


def test_one_of_each_group_stays(steps):
    _, before, after = steps[2]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    component, _ = brute(texts, 5, 80)
    assert {r["doc_id"] for r in after.collect()} == {i for i in texts if component[i] == i}


def test_mixture_and_packing(steps):
    _, before, after = steps[3]
    plan = {r["doc_id"]: r["whole_copies"] for r in mixing.mix(before).collect()}
    copies = Counter(r["doc_id"] for r in after.collect())
    assert copies == +Counter(plan)
    _, before, after = steps[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    rows = after.collect()
    assert sum(r["length"] for r in rows) == total
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(spans[-1]) <= 2048
    assert len(places) <= 1.02 * np.ceil(total / 2048) + 1


def test_odd_documents_run_through(spark, odd, empty):
    seen = {}
    for docs in (odd, empty):
        frame = docs.select("doc_id", "text", "lang", "source", "size", "target")
        for name, stage in corpus_pipeline.STAGES:
            before, frame = frame, written(stage(spark, frame, DIRECTORY), "test-odd")
            seen[name] = (before.collect(), frame.collect())
            if name != "packing":
                assert frame.columns == before.columns
            if docs is empty:
                assert not seen[name][1]
                continue
            if name in ("language", "toxicity", "near_copies"):
                assert not Counter(seen[name][1]) - Counter(seen[name][0])
            if name == "language":
                assert not {3, 4, 5, 6} & {r["doc_id"] for r in seen[name][1]}
            if name == "near_copies":
                texts = [r["text"] for r in seen[name][1]]
                assert len(texts) == len(set(texts)) and set(texts) == {r["text"] for r in seen[name][0]}
            if name == "packing":
                assert sum(r["length"] for r in seen[name][1]) >= len(seen[name][0])
