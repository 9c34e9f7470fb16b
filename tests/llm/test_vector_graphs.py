"""Near vectors against a scan of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillweave.llm import vector_graphs as vg
from tillweave.llm.queries import op12_vector_graphs

SCHEMA = "vec_id long, embedding array<double>, label int, key int, links string"


def slow(rows, least=0.93):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, vector, label), by comparing all pairs."""
    fine = [
        v is not None and label is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for i, v, label in rows
    ]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and fine[a] and fine[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (a, b))
                near[a, b] = x @ y / np.sqrt((x @ x) * (y @ y)) >= least
    of = list(range(n))
    for a in range(n):
        for b in np.flatnonzero(near[a]):
            old, new = of[b], of[a]
            of = [new if o == old else o for o in of]
    found = []
    for a in range(n):
        first = rows[a][0] if not fine[a] else min(rows[b][0] for b in range(n) if of[b] == of[a] and fine[b])
        found.append((rows[a][0], int(near[a].sum()), first, rows[a][0] is None or rows[a][0] == first))
    return sorted(found, key=str)


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


def got_of(frame):
    return sorted([tuple(r) for r in frame.select("vec_id", "n_links", "component_id", "kept").collect()], key=str)


def clusters(seed, sizes, dims=12, noise=0.12):
    draw = np.random.default_rng(seed)
    rows, at = [], 0
    for label, size in enumerate(sizes):
        middle = draw.normal(size=dims)
        for i in range(size):
            x = middle + noise * np.linalg.norm(middle) / np.sqrt(dims) * draw.normal(size=dims) if i % 2 else draw.normal(size=dims)
            rows.append((int(at * 7919 % 10007), (x * 10.0 ** draw.integers(-3, 4)).tolist(), label % 3 if label else None))
            at += 1
    return rows


@pytest.mark.parametrize("shard_rows", [20, 8192])
def test_links_equal_brute_force(spark, shard_rows):
    """Groups of copies, one label spread over many shards, other scales of the same direction."""
    rows = clusters(1, [10, 150, 40, 7])
    rows += [(20_000 + i, rows[20][1], rows[20][2]) for i in range(30)]  # exact copies
    got = got_of(vg.near_vectors(frame_of(spark, rows), shard_rows=shard_rows, audit=1024))
    assert got == slow(rows)


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [0.0, 0.0], 1),
        (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0], None),
        (None, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1e300, 1e-300], 2), (14, [1e-300, 0.0], 2), (15, [-1.0, -0.0], 2),
        (16, [0.0, 1.0], 1), (1, [0.0, 3.0], 1),
    ]
    assert got_of(vg.near_vectors(frame_of(spark, rows))) == slow(rows)


def test_empty(spark):
    assert vg.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert got_of(op12_vector_graphs(spark, "/root/testdata/sf0.001")) == slow(rows)


def test_graph_finds_what_a_scan_finds():
    """Recall of the search alone, without the audit, on more vectors than a beam can hold; and beams that widen."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(3000, 24))
    x[:600] = x[0] + 0.2 * draw.normal(size=(600, 24))  # one crowded place
    x[1000:2000] = x[2000:] + 0.15 * draw.normal(size=(1000, 24))
    unit = vg.unit_rows(x)
    graph = vg.build(unit)
    true = unit @ unit.T >= 0.93
    hit = vg.search(graph, unit, 0.93, 32)
    assert not (hit & ~true).any() and (hit & true).sum() >= 0.99 * true.sum()
    audited, width = vg.audited(graph, unit, 0.93, len(unit))
    assert (audited == true).mean() > 0.999999 and width >= 32


def test_audit_widens_the_beams_of_a_bad_graph():
    """With links cut at random, narrow beams lose links; the audit sees it and does not stop before none is lost."""
    draw = np.random.default_rng(4)
    x = np.repeat(draw.normal(size=(400, 16)), 2, axis=0) + 0.01 * draw.normal(size=(800, 16))
    graph = vg.build(vg.unit_rows(x))
    for links in graph.layers:
        links[draw.random(links.shape) < 0.9] = -1
    true = graph.unit @ graph.unit.T >= 0.93
    assert (true & ~vg.search(graph, graph.unit, 0.93, 32)).any()
    hit, width = vg.audited(graph, graph.unit, 0.93, 800)
    assert width > 32 and (hit == true).all()


def test_links_are_not_listed_as_pairs(spark):
    """1,000 near copies have half a million links; what leaves the tasks grows with the vectors."""
    draw = np.random.default_rng(5)
    x = np.ones(16) + 0.05 * draw.normal(size=(1000, 16))
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    rows, classes = vg._classes(frame)
    links = vg.pair_links(vg.shard_pairs(classes, 400, 1 << 22), 0.93, 256)
    assert links.count() <= 3 * 6 * 1000
    got = vg.near_vectors(frame, shard_rows=400).agg(F.sum("n_links"), F.countDistinct("component_id")).first()
    assert tuple(got) == (1000 * 999, 1)
