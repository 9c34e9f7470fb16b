"""Spelling groups against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillweave.llm import spelling
from tillweave.llm.queries import op11_spelling


def slow_counts(rows, every, least_chars=5, least_count=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and code % every == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count and len(w) >= least_chars}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_groups(counts, times=2):
    found = {}
    for word, n in counts.items():
        near = [(-m, other) for other, m in counts.items() if other != word and is_near(word, other)]
        best = min(near, default=None)
        found[word] = (best[1], -best[0], len(near)) if best and -best[0] >= times * n else (None, None, len(near))
    rows = set()
    for word, n in counts.items():
        root = word
        while found[root][0] is not None:
            root = found[root][0]
        rows.add((word, found[word][0], root, n, found[word][2], found[word][1]))
    return rows


def rows_of(frame):
    return [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_brute_force_on_crowded_words(spark, seed):
    """Short words over few letters: runs of equal letters, long chains, many ties, several near words under one prefix."""
    draw = random.Random(seed)
    counts = {"".join(draw.choice("abé") for _ in range(draw.randint(1, 6))): draw.choice([1, 2, 2, 4, 9, 20]) for _ in range(300)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("prefix", F.lit(1)).repartition(5)
    got = rows_of(spelling.group_spellings(words))
    assert len(got) == len(counts) and set(got) == slow_groups(counts)


def test_chain_of_forms_is_followed_to_its_end(spark):
    counts = {"b" + "a" * i: 2**i for i in range(1, 30)}
    got = {r[0]: r for r in rows_of(spelling.group_spellings(spark.createDataFrame(list(counts.items()), "word string, n long")))}
    assert {r[2] for r in got.values()} == {"b" + "a" * 29} and got["ba"][1] == "baa" and got["b" + "a" * 29][1] is None


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = slow_groups(slow_counts([(r.doc_id, r.text) for r in docs.collect()], 97))
    got = rows_of(op11_spelling(spark, "/root/testdata/sf0.001"))
    assert len(got) == len(want) and set(got) == want and any(r[1] for r in got)


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(20, "Straße STRASSE Éclair éclair × a×b ÷ÿ ſ Ω naïve")] * 4
    docs = odd.select("doc_id", "text", "size").unionByName(spark.createDataFrame([(*r, 1) for r in rows[-4:]], "doc_id long, text string, size int"))
    for every in (None, 1, 3):
        got = {r.word: r.n for r in spelling.count_words(docs, erase_every=every, least_chars=2, least_count=1).collect()}
        assert got == slow_counts(rows, every, 2, 1)


def test_counts_do_not_depend_on_what_a_task_holds(spark, documents, monkeypatch):
    whole = {tuple(r) for r in spelling.count_words(documents, erase_every=97).collect()}
    assert {tuple(r) for r in spelling.count_words(documents.repartition(7), erase_every=97).collect()} == whole


def test_empty_and_null_words(spark, empty):
    assert spelling.group_spellings(spelling.count_words(empty)).count() == 0
    words = spark.createDataFrame([(None, 5), ("alone", 3)], "word string, n long")
    assert rows_of(spelling.group_spellings(words)) == [("alone", None, "alone", 3, 0, None)]
