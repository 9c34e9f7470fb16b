"""Vector codes against a plain version in Python's integers."""

import hashlib
import math
from itertools import product

import numpy as np
import pytest

from tillweave.llm import vector_codes as vc
from tillweave.llm.queries import op13_vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, row int, error string, v int"


def slow(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    ordered = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(ordered[0][1])
    spans = vc.cuts(width, parts)
    books = [[v[a:b] for _, v, _ in ordered if len(v) == width] for a, b in spans]
    fits = [r for r in kept if len(r[1]) == width]

    def assign():
        found = []
        for _, v, _ in fits:
            line = []
            for (a, b), book in zip(spans, books):
                apart = [sum((x - c) ** 2 for x, c in zip(v[a:b], entry)) for entry in book]
                line.append((apart.index(min(apart)), min(apart)))
            found.append(line)
        return found

    for _ in range(rounds):
        found = assign()
        for p, (a, b) in enumerate(spans):
            for e in range(len(books[p])):
                mine = [v[a:b] for (_, v, _), line in zip(fits, found) if line[p][0] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    lines = iter(assign())
    result = []
    for i, v, label in kept:
        line = next(lines) if len(v) == width else None
        result.append([i, line and "".join(f"{e:02x}" for e, _ in line), line and sum(d for _, d in line), label])
    sums = {}
    for r in result:
        sums[r[3]] = sums.get(r[3], 0) + (r[2] or 0)
    return sorted([(i, code, error, sums[label] if code is not None else None, digest) for i, code, error, label in result], key=str)


def got_of(frame):
    return sorted([tuple(r) for r in frame.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()], key=str)


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("block_rows", [1, 7, 512])
def test_codes_equal_plain_version(spark, block_rows):
    draw = np.random.default_rng(2)
    rows = [(int(i * 37 % 401), (draw.normal(size=8) * 0.3).tolist(), [None, 1, 2][i % 3]) for i in range(180)]
    rows += [(500 + i, rows[5][1], 1) for i in range(90)]  # a third of all rows are one vector
    got = got_of(vc.vector_codes(frame_of(spark, rows), entries=16, block_rows=block_rows))
    assert got == slow(rows, entries=16)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.5, -0.25, 0.1, 1.0, -1.0], 1), (3, [0.5, -0.25, 0.1, 1.0, -1.0], 1), (1, [0.0, 0.0, -0.0, 0.0, 0.0], None), (None, [0.1] * 5, None),
            (4, None, 1), (5, [nan] * 5, 1), (6, [inf] * 5, 1), (7, [None, 1.0, 1.0, 1.0, 1.0], 1), (8, [1.0] * 3, 1), (9, [], 2), (3, [-1e-9] * 5, 2)]
    assert got_of(vc.vector_codes(frame_of(spark, rows))) == slow(rows)


def test_large_components_are_exact_and_too_large_ones_refused(spark):
    rows = [(i, [1e5 * math.sin(i * j + 1) for j in range(8)], i % 2) for i in range(40)]
    assert got_of(vc.vector_codes(frame_of(spark, rows), entries=8)) == slow(rows, entries=8)
    with pytest.raises(ValueError, match="too large"):
        vc.vector_codes(frame_of(spark, [(1, [1e9] * 8, 1)]))


def test_empty_tables(spark):
    assert vc.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got_of(vc.vector_codes(frame_of(spark, [(1, [], 1), (2, None, 1)])))[0][:3] == (1, None, None)


def test_query_equals_plain_version(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(300).collect()]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert got_of(vc.vector_codes(frame)) == slow(rows)
    assert op13_vector_codes(spark, "/root/testdata/sf0.001").count() == 500


def test_curve_visits_neighbours():
    """Consecutive positions of the curve differ by one step in one dimension, and every cell has a position of its own."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(product(range(1 << bits), repeat=dims)))
        keys = vc.hilbert_keys(cells, bits)
        order = cells[np.argsort(np.array(keys, dtype=object))]
        assert len(set(keys)) == len(cells)
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_lose_no_nearest_entry_and_rule_some_out():
    draw = np.random.default_rng(6)
    book = draw.integers(-900, 900, (64, 3))
    shorter = 0
    for _ in range(200):
        x = draw.integers(-900, 900, 3) + draw.integers(-60, 60, (20, 3))
        short = vc.shortlist(x.min(axis=0), x.max(axis=0), book)
        whole, error = vc.nearest(x, book, True)
        at, same = vc.nearest(x, book[short], False)
        assert (short[at] == whole).all() and (error == same).all()
        shorter += len(short) < 32
    assert shorter > 100
