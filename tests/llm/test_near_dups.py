import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tillweave.llm import near_dups, queries


def shingles(text, width):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(texts, width, percent):
    """Smallest id reachable, over all links between equal or similar sets."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    holders, shared, parent = defaultdict(list), Counter(), {i: i for i in texts}
    for i in sorted(sets):
        for s in sets[i]:
            for j in holders[s]:
                shared[j, i] += 1
            holders[s].append(i)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, j), both in shared.items():
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: root(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def compare(spark, texts, width, percent):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    component, sizes = brute(texts, width, percent)
    rows = near_dups.near_duplicates(docs, width=width, percent=percent).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["component_id"], r["n_shingles"]) == (component[r["doc_id"]], sizes[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_query_equals_brute_force(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    component, sizes = brute(texts, 3, 85)
    for r in queries.op2_near_dups(spark, "/root/testdata/sf0.001").collect():
        assert (r["component_id"], r["n_shingles"]) == (component[r["doc_id"]], sizes[r["doc_id"]])


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_crowded_group_of_near_copies_and_chains(spark, width, percent):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    base = [word() for _ in range(160)]
    texts = {}
    for i in range(250):  # a group larger than a region, each copy with up to three edits of its own
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = word()
        texts[i] = " ".join(copy)
    walk = [word() for _ in range(200)]
    for i in range(250, 300):  # a chain: neighbours are alike, its ends are not
        walk[rng.randrange(200)] = word()
        walk[rng.randrange(200)] = word()
        texts[i] = " ".join(walk)
    for i in range(300, 400):
        texts[i] = " ".join(word() for _ in range(rng.randrange(1, 60)))
    for i in range(400, 440):
        texts[i] = texts[rng.randrange(400)].upper() if i % 2 else texts[rng.randrange(400)]
    compare(spark, texts, width, percent)


def test_copies_that_only_their_original_links(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(400)]
    texts = {}
    for i in range(1200):  # eight edits of its own each: like the original, but not like each other
        copy = list(base)
        for at in rng.sample(range(5, 395), 8) if i != 600 else []:
            copy[at] = word()
        texts[i] = " ".join(copy)
    for i in range(1200, 1300):
        texts[i] = " ".join(word() for _ in range(50))
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    alike = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    assert all(alike(i, 600) for i in range(1200))
    assert not any(alike(i, j) for i in range(5) for j in range(1200) if j not in (i, 600))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = near_dups.near_duplicates(docs, width=5, percent=80).collect()
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == len(texts)
    apart = sum(found[i] != 0 for i in range(1200))
    assert apart == 0, f"{apart} of 1200 copies are apart"
    assert all(found[i] == i for i in range(1200, 1300))


def test_overlaps_are_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(1, 400))) for _ in range(90)]
    wanted = rng.random((40, 50)) < 0.9
    for mask in (wanted, wanted & (rng.random((40, 50)) < 0.1)):
        got = near_dups.overlaps(sets[:40], sets[40:], mask)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[40 + j])) for i, j in zip(*np.nonzero(mask)))


def test_odd_rows(odd, empty):
    rows = near_dups.near_duplicates(odd, width=3, percent=85).collect()
    assert len(rows) == odd.count()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert [r["component_id"] for i in (1, 2) for r in by_id[i]] == [1, 1]
    for i in (3, 4, 5):
        assert by_id[i][0]["n_shingles"] == 0 and by_id[i][0]["component_id"] == i and by_id[i][0]["kept"]
    assert len(by_id[7]) == 2 and all(r["kept"] for r in by_id[7])
    assert by_id[None][0]["component_id"] is None and by_id[None][0]["kept"]
    assert by_id[6][0]["n_shingles"] == 1 and by_id[9][0]["n_shingles"] == 1
    assert near_dups.near_duplicates(empty).count() == 0


def test_estimates_follow_the_sets():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
    b = np.concatenate([a[:1700], np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))])
    same = (near_dups.minhashes(a) == near_dups.minhashes(b)).mean()
    assert abs(same - 1700 / 2300) < 0.15


@pytest.mark.parametrize("rows", [[], None])
def test_keep_one_row_by_row(spark, rows):
    a, b = " ".join(f"a{i}" for i in range(120)), " ".join(f"b{i}" for i in range(120))
    near = a.replace("a60", "x")
    if rows is None:
        rows = [
            (5, a, "first"),
            (5, b, "same id, other text"),
            (5, a, "first"),
            (3, near, "near copy with a smaller id"),
            (None, a, "copy without an id"),
            (None, "words that nothing else has at all", "no id, alone"),
            (None, "words that nothing else has at all", "no id, again"),
            (8, b, "copy of the other text"),
            (9, "", "empty"),
            (9, "", "empty"),
            (10, None, "null"),
        ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    got = near_dups.keep_one(docs, width=5, percent=80)
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, r["text"] or "", r["text"] is None) for r in got.collect())
    wanted = [(3, near, False), (5, b, False), (0, "words that nothing else has at all", False), (9, "", False), (9, "", False), (10, "", True)]
    assert kept == (sorted(wanted) if rows else [])
