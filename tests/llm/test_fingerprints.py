import hashlib

import numpy as np

from tillweave.llm import fingerprints, queries


def expected(texts):
    """Per document: hash of the edited text, and both likenesses."""
    out = {}
    for (key, text), (_, following) in zip(texts, texts[1:] + texts[:1]):
        over = len(text) // 4
        changed = text[: len(text) - over] + following[:over]
        mark, other, after = (fingerprints.fingerprint(t) for t in (text, changed, following))
        out[key] = (
            len(text),
            hashlib.sha256(changed.encode()).hexdigest(),
            mark.hex(),
            other.hex(),
            fingerprints.likeness(mark, other),
            fingerprints.likeness(mark, after),
        )
    return out


NAMES = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_query_equals_brute_force(spark, documents):
    wanted = expected(sorted((r["doc_id"], r["text"] or "") for r in documents.collect()))
    rows = queries.op7_fingerprints(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: tuple(r[n] for n in NAMES) for r in rows} == wanted
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.95


def test_likeness_falls_with_edits():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdefghij "), 4000))
    marks = [fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint("z" * n + text[n:])) for n in (0, 200, 1000, 4000)]
    assert marks[0] == 1 and marks[0] > marks[1] > marks[2] > marks[3]
    # the order of the k-mers counts, not only which there are
    swapped = text[2000:] + text[:2000]
    assert fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(swapped)) < 0.8


def test_odd_rows(spark, odd, empty):
    rows = fingerprints.fingerprint_documents(odd).collect()
    assert len(rows) == odd.count()
    ordered = sorted(odd.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    wanted = expected([((r["doc_id"], i), r["text"] or "") for i, r in enumerate(ordered)])
    assert sorted((tuple(r[n] for n in NAMES) for r in rows), key=str) == sorted(wanted.values(), key=str)
    assert fingerprints.fingerprint_documents(empty).count() == 0
    single = spark.createDataFrame([(5, "only one text here")], "doc_id long, text string")
    row = fingerprints.fingerprint_documents(single).first()
    assert row["near_next"] == 1.0
