import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tillweave.llm import language, queries


def slow_bits(samples, name, text):
    """Code length of a text byte by byte, with dictionaries."""
    order = language.ORDER
    counts = {}
    for sample in samples[name]:
        for i in range(len(sample)):
            for k in range(min(i, order) + 1):
                counts.setdefault(sample[i - k : i], {}).setdefault(sample[i], 0)
                counts[sample[i - k : i]][sample[i]] += 1
    known = set()
    for texts in samples.values():
        for sample in texts:
            known |= set(sample)
    total, padded = 0.0, b" " * order + text
    for i, byte in enumerate(text):
        context = padded[i : i + order]
        for k in range(order, -2, -1):
            if k == -1:
                total += 8
                break
            seen = counts.get(context[order - k :])
            if not seen:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if byte in seen:
                total -= np.log2(seen[byte] / (n + kinds))
                break
            total -= np.log2(kinds / (n + kinds))
    return total


def test_code_lengths_are_exact():
    samples = {"a": [b"the cat sat on the mat ", b"a hat"], "b": [b"le chat est la ", "été à Paris".encode()]}
    trees = language.ContextTrees.of(samples)
    texts = [b"the chat sat", b"", "été 中 z".encode(), b"x" * 30]
    for block in (4, 1 << 16):
        for text, got in zip(texts, trees.bits(texts, block), strict=True):
            for at, name in enumerate(trees.languages):
                assert abs(got[at] - slow_bits(samples, name, text)) < 1e-5


def test_languages_take_room_for_their_own_samples_only():
    alphabet = "abcdefghijklmnopqrstuvwxyz "
    draw = np.random.default_rng(5)
    samples = {f"l{i}": ["".join(draw.choice(list(alphabet), 3000)).encode() for _ in range(3)] for i in range(40)}
    room = lambda trees: sum(len(part.values) for part in (*trees.escapes, *trees.savings))
    alone = sum(room(language.ContextTrees.of({name: texts})) for name, texts in samples.items())
    assert room(language.ContextTrees.of(samples)) == alone


def test_counts_of_the_sample_equal_those_of_its_texts(documents):
    learn = F.col("doc_id") % 2 == 0
    trees = language.learned(documents, learn, None, 5)
    samples = {}
    for r in language.training_sample(documents, F.col("lang"), learn, 5).collect():
        samples.setdefault(r["sample_lang"], []).append(r["sample_text"].encode())
    texts = [r["text"].encode() for r in documents.limit(20).collect() if r["text"]]
    assert trees.languages == sorted(samples)
    assert np.array_equal(trees.bits(texts), language.ContextTrees.of(samples).bits(texts))


def test_query_on_held_out_documents(spark, documents):
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = queries.op5_language(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_odd_rows(odd, empty):
    rows = language.predict_language(odd, learn=F.lit(True)).collect()
    assert len(rows) == odd.count()
    found = {r["doc_id"]: r for r in rows}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (3, 4, 5, 6))
    assert found[7]["lang_pred"] == "fr" and found[1]["lang_pred"] == "en"
    assert language.predict_language(empty, learn=F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in language.predict_language(odd, learn=F.lit(False)).collect()} == {"und"}
    kept = language.keep_known(odd, learn=F.lit(True))
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 7, 8, 9, None}


def test_sample_is_bounded_and_stable(documents):
    def sample(docs):
        return sorted(map(tuple, language.training_sample(docs, F.col("lang"), F.lit(True), 5).collect()))

    first = sample(documents)
    assert set(Counter(name for name, _ in first).values()) == {5}
    assert first == sample(documents.repartition(5))
