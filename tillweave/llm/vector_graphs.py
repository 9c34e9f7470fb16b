"""Near copies among vectors: hierarchical navigable small-world graphs per shard, audited beams, exact cosine, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.llm.near_dups import components
from tillweave.llm.tables import written
from tillweave.llm.vector_codes import finite

_LINKS = 16  # of a node in the upper layers; twice as many in the lowest
_BUILD = 64  # beam width while a graph is built
_BLOCK = 256  # nodes put in, or queries run, at once
_SLACK = 1e-5  # candidates are found in single precision and confirmed in double precision


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in single precision."""
    return (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, so that no square overflows or vanishes; the quotients are exact."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if len(x) else x


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` and the same row of ``y``, in double precision."""
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


class Graph:
    """A navigable small-world graph over unit vectors. ``layers[l]`` holds the links of each node in layer l, -1 where none."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], entry: np.ndarray):
        self.unit, self.layers, self.entry = unit, layers, entry

    def beam(self, layer: int, queries: np.ndarray, start: np.ndarray, width: int, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Best ``width`` nodes of a layer for each query, from ``start`` (nodes, -1 where none): (nodes, likeness), unordered.

        Each step expands the best nodes not yet expanded; a query ends when its beam holds none. ``seen`` gets all nodes met.
        """
        q, s = len(queries), len(self.unit)
        links = self.layers[layer]
        visited = np.zeros(q * s, bool)
        node = np.full((q, width), -1, np.int64)
        like = np.full((q, width), -np.inf, np.float32)
        done = np.ones((q, width), bool)
        at_once = max(4, width // 16)

        def meet(row: np.ndarray, met: np.ndarray) -> None:
            code = np.unique(row * s + met)
            code = code[~visited[code]]
            visited[code] = True
            row, met = np.divmod(code, s)
            found = np.empty(len(code), np.float32)
            for low in range(0, len(code), 1 << 16):
                part = slice(low, low + (1 << 16))
                found[part] = np.einsum("ij,ij->i", self.unit[met[part]], queries[row[part]])
            if seen is not None:
                seen.append((row, met, found))
            rows, begins, counts = np.unique(row, return_index=True, return_counts=True)
            if not len(rows):
                return
            place = np.arange(len(row)) - np.repeat(begins, counts)
            line = np.repeat(np.arange(len(rows)), counts)
            shape = (len(rows), int(counts.max()))
            new_node, new_like = np.full(shape, -1, np.int64), np.full(shape, -np.inf, np.float32)
            new_node[line, place], new_like[line, place] = met, found
            all_node = np.concatenate([node[rows], new_node], axis=1)
            all_like = np.concatenate([like[rows], new_like], axis=1)
            all_done = np.concatenate([done[rows], new_node < 0], axis=1)
            keep = np.argpartition(-all_like, width - 1, axis=1)[:, :width]
            node[rows], like[rows], done[rows] = (np.take_along_axis(x, keep, axis=1) for x in (all_node, all_like, all_done))

        row, column = np.nonzero(start >= 0)
        meet(row, start[row, column])
        while True:
            active = np.flatnonzero(~done.all(axis=1))
            if not len(active):
                return node, like
            open_ = np.where(done[active], -np.inf, like[active])
            pick = np.argpartition(-open_, min(at_once, width) - 1, axis=1)[:, : min(at_once, width)]
            line, which = np.nonzero(np.take_along_axis(open_, pick, axis=1) > -np.inf)
            row, column = active[line], pick[line, which]
            done[row, column] = True
            near = links[node[row, column]]
            row, near = np.repeat(row, near.shape[1]), near.ravel()
            meet(row[near >= 0], near[near >= 0])

    def descend(self, queries: np.ndarray, to: int, width: int = 8) -> np.ndarray:
        """Nodes from which a search of layer ``to`` starts: the best ones of the layer above, found from the top down."""
        start = np.repeat(self.entry[None], len(queries), axis=0)
        for layer in range(len(self.layers) - 1, to, -1):
            start, _ = self.beam(layer, queries, start, width)
        return start


def _diverse(unit: np.ndarray, node: np.ndarray, like: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (-1 where none) up to ``most``: first those closer to the row's own node than to any chosen
    one, best first, then the best of the rest."""
    order = np.argsort(-like, axis=1, kind="stable")
    node, like = np.take_along_axis(node, order, axis=1), np.take_along_axis(like, order, axis=1)
    b, c = node.shape
    x = unit[node]
    between = np.matmul(x, x.transpose(0, 2, 1))
    chosen = np.zeros((b, c), bool)
    for i in range(c):
        nearer = np.where(chosen, between[:, i], -np.inf).max(axis=1) if i else np.full(b, -np.inf)
        chosen[:, i] = (node[:, i] >= 0) & (nearer < like[:, i]) & (chosen.sum(axis=1) < most)
    rank = np.argsort(np.where(node < 0, 2, ~chosen), axis=1, kind="stable")[:, :most]
    kept = np.take_along_axis(node, rank, axis=1)
    return np.pad(kept, ((0, 0), (0, most - kept.shape[1])), constant_values=-1)


def build(unit: np.ndarray, seed: int = 7) -> Graph:
    """Put nodes in block by block: each block searches what is there, sees its own members, and links both ways."""
    n = len(unit)
    level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(_LINKS)).astype(int), 6)
    top = int(level.max()) if n else 0
    graph = Graph(unit, [np.full((n, _LINKS * (1 if layer else 2)), -1, np.int64) for layer in range(top + 1)], np.zeros(0, np.int64))
    for begin in range(0, n, _BLOCK):
        block = np.arange(begin, min(begin + _BLOCK, n))
        own = unit[block] @ unit[block].T
        np.fill_diagonal(own, -np.inf)
        reached = int(level[:begin].max()) if begin else -1
        start = np.repeat(np.flatnonzero(level[:begin] == reached)[:_BUILD][None], len(block), axis=0)
        for layer in range(top, -1, -1):
            here = level[block] >= layer
            found_node, found_like = np.full((len(block), 0), -1, np.int64), np.full((len(block), 0), -np.inf, np.float32)
            if layer <= reached:
                found_node, found_like = graph.beam(layer, unit[block], start, _BUILD if here.any() else 8)
                start = found_node
            if not here.any():
                continue
            mates = own[here][:, here]
            few = min(_BUILD, mates.shape[1])
            best = np.argpartition(-mates, few - 1, axis=1)[:, :few]
            mate_like = np.take_along_axis(mates, best, axis=1)
            mate_node = np.where(mate_like > -np.inf, block[here][best], -1)
            node = np.concatenate([found_node[here], mate_node], axis=1)
            like = np.concatenate([found_like[here], mate_like], axis=1)
            links = graph.layers[layer]
            links[block[here]] = _diverse(unit, node, like, links.shape[1])
            _link_back(graph, layer, block[here])
    graph.entry = np.flatnonzero(level == top)[:_BUILD]
    return graph


def _link_back(graph: Graph, layer: int, block: np.ndarray) -> None:
    """Add the links from a block's nodes to the other ends' lists, which keep their most diverse ones."""
    links = graph.layers[layer]
    most = links.shape[1]
    ends = links[block]
    source, target = np.repeat(block, most)[ends.ravel() >= 0], ends.ravel()[ends.ravel() >= 0]
    present = (links[target] == source[:, None]).any(axis=1)
    source, target = source[~present], target[~present]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, begins, counts = np.unique(target, return_index=True, return_counts=True)
    for low in range(0, len(nodes), _BLOCK):
        part = slice(low, low + _BLOCK)
        width = int(counts[part].max())
        new = np.full((len(nodes[part]), width), -1, np.int64)
        for i, (begin, count) in enumerate(zip(begins[part], counts[part])):
            new[i, :count] = source[begin : begin + count]
        node = np.concatenate([links[nodes[part]], new], axis=1)
        like = np.einsum("bcd,bd->bc", graph.unit[node], graph.unit[nodes[part]])
        like[node < 0] = -np.inf
        if node.shape[1] > 3 * most:
            best = np.argpartition(-like, 3 * most - 1, axis=1)[:, : 3 * most]
            node, like = np.take_along_axis(node, best, axis=1), np.take_along_axis(like, best, axis=1)
        links[nodes[part]] = _diverse(graph.unit, node, like, most)


def search(graph: Graph, queries: np.ndarray, least: float, width: int) -> np.ndarray:
    """Which nodes are as like as ``least`` to each query, as far as beams of ``width`` find: a table of booleans.

    A query whose beam is full of such nodes is run again with a beam four times as wide. A beam of a quarter of the shard
    would meet nearly all of it anyway, so from there on it takes the shard as a whole.
    """
    n = len(graph.unit)
    hit = np.zeros((len(queries), n), bool)
    open_ = np.arange(len(queries))
    while len(open_):
        more = []
        rows = max(8, min(_BLOCK, (1 << 22) // max(n, 32 * width)))
        for low in range(0, len(open_), rows):
            part = open_[low : low + rows]
            if 4 * width >= n:
                hit[part] = queries[part] @ graph.unit.T >= least
                continue
            seen: list = []
            _, like = graph.beam(0, queries[part], graph.descend(queries[part], 0), width, seen)
            for row, met, found in seen:
                hit[part[row[found >= least]], met[found >= least]] = True
            more.append(part[(like >= least).all(axis=1)])
        open_ = np.concatenate(more) if more else open_[:0]
        width *= 4
    return hit


def audited(graph: Graph, queries: np.ndarray, least: float, audit: int, width: int = 32) -> tuple[np.ndarray, int]:
    """``search`` with the first beam width that loses no link of the first ``audit`` queries, as a scan of the shard finds
    them; and that width. Widths double; the last one takes the shard as a whole, which loses none."""
    true = queries[:audit] @ graph.unit.T >= least + _SLACK
    while True:
        hit = search(graph, queries[:audit], least, width)
        if not (true & ~hit).any():
            return np.concatenate([hit, search(graph, queries[audit:], least, width)]), width
        width *= 2


def forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what ``hit`` joins, without a cycle: each node that is not first in its part with the part's first one."""
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    of = np.arange(len(nodes))
    at_left, at_right = place[: len(left)], place[len(left) :]
    for i in np.flatnonzero(hit.any(axis=1)):
        joined = np.unique(of[np.append(at_right[hit[i]], at_left[i])])
        if len(joined) > 1:
            of[np.isin(of, joined)] = joined[0]
    moved = np.flatnonzero(of != np.arange(len(nodes)))
    return list(zip(nodes[moved].tolist(), nodes[of[moved]].tolist()))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (``vec_id``, ``label``, ``size``, ``h1``, ``h2``) and the classes of equal usable vectors within a label."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    some = F.exists("v", lambda x: x != 0.0)
    rows = vectors.select("vec_id", F.col("label").alias("of"), values.alias("v"), finite(F.col("embedding")).alias("fine"))
    usable = F.col("fine") & F.coalesce(some, F.lit(False)) & F.col("of").isNotNull() & F.col("vec_id").isNotNull()
    key = F.when(usable, F.struct("of", F.size("v").alias("size"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(12), F.col("v")).alias("h2")))
    rows = rows.withColumn("key", key)
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    return rows.select("vec_id", "key"), written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")


def shard_pairs(classes: DataFrame, shard_rows: int, shard_values: int) -> DataFrame:
    """Graph nodes of all shards, each shard's sent to every pair of shards of its label (``left`` <= ``right``) it is in."""
    group = [F.col("key.of").alias("of"), F.col("key.size").alias("size")]
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(shard_values) / F.col("size"))))
    sizes = written(classes.groupBy(*group).agg(F.count(F.lit(1)).alias("rows")).withColumn("shards", F.ceil(F.col("rows") / most).cast("int")), "vector-shards")
    rows = classes.select(*group, "node", "n", "v").join(sizes.drop("rows"), ["of", "size"])
    rows = written(rows.withColumn("shard", F.pmod(F.xxhash64("node"), "shards").cast("int")), "vector-rows")
    schema = T.StructType([*rows.schema, T.StructField("links", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        x = _matrix(table)
        graph = build(unit_rows(scaled(x)))
        on = [(layer >= 0).any(axis=1) for layer in graph.layers]
        entry = np.isin(np.arange(len(x)), graph.entry)
        links = []
        for i in range(len(x)):
            high = max([at for at, used in enumerate(on) if used[i]] + [len(on) - 1 if entry[i] else 0])
            links.append([layer[i][layer[i] >= 0].tolist() for layer in graph.layers[: high + 1]])
        return table.append_column("links", pa.array(links, pa.list_(pa.list_(pa.int32()))))

    grown = written(rows.groupBy("of", "size", "shard").applyInArrow(grow, schema), "vector-graphs")
    paired = grown.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    return paired.withColumn("left", F.least("shard", "other")).withColumn("right", F.greatest("shard", "other")).drop("other", "shards")


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(table.num_rows, -1)


def _graph_of(table: pa.Table) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """Graph, nodes, counts and vectors of one shard's rows."""
    table = table.sort_by("node")
    x = scaled(_matrix(table))
    per_node = table.column("links").to_pylist()
    top = max(len(p) for p in per_node)
    layers = []
    for layer in range(top):
        links = np.full((len(x), _LINKS * (1 if layer else 2)), -1, np.int64)
        for i, lists in enumerate(per_node):
            if layer < len(lists):
                links[i, : len(lists[layer])] = lists[layer]
        layers.append(links)
    entry = np.array([i for i, p in enumerate(per_node) if len(p) == top][:_BUILD], np.int64)
    return Graph(unit_rows(x), layers, entry), table.column("node").to_numpy(), table.column("n").to_numpy(), x


def pair_links(pairs: DataFrame, least: float, audit: int) -> DataFrame:
    """Links found in each pair of shards: per node ``many`` (linked vectors there) or ``other`` (a node of the same part).

    Every node of either shard queries the other's graph (its own, where a shard meets itself); a pair that one direction finds
    counts for both. All pairs found are confirmed in double precision.
    """

    def link(table: pa.Table) -> pa.Table:
        left, right = (table.column(c)[0].as_py() for c in ("left", "right"))
        shard = table.column("shard").to_numpy()
        a = _graph_of(table.filter(pa.array(shard == left)))
        b = a if left == right else _graph_of(table.filter(pa.array(shard == right)))
        hit, _ = audited(b[0], a[0].unit, least - _SLACK, audit)
        back = hit if left == right else audited(a[0], b[0].unit, least - _SLACK, audit)[0]
        hit = hit | back.T
        if left == right:
            np.fill_diagonal(hit, False)
        for low in range(0, len(hit), 64):
            row, column = np.nonzero(hit[low : low + 64])
            for at in range(0, len(row), 1 << 16):
                i, j = row[at : at + (1 << 16)] + low, column[at : at + (1 << 16)]
                hit[i, j] = cosines(a[3][i], b[3][j]) >= least
        counts = [(a[1], hit @ b[2])] + ([] if left == right else [(b[1], hit.T @ a[2])])
        joined = forest(hit, a[1], b[1])
        node = [np.asarray(nodes)[many > 0] for nodes, many in counts] + [np.array([e[0] for e in joined], np.int64)]
        many = [many[many > 0] for _, many in counts]
        rows = sum(len(m) for m in many)
        return pa.table(
            {
                "node": pa.array(np.concatenate(node), pa.int64()),
                "many": pa.array(np.concatenate(many).tolist() + [None] * len(joined), pa.int64()),
                "other": pa.array([None] * rows + [e[1] for e in joined], pa.int64()),
            }
        )

    return written(pairs.groupBy("of", "size", "left", "right").applyInArrow(link, "node long, many long, other long"), "vector-links")


def near_vectors(
    vectors: DataFrame, *, least: float = 0.93, shard_rows: int = 8192, shard_values: int = 1 << 22, audit: int = 1024
) -> DataFrame:
    """Near copies among ``vectors`` (``vec_id``, ``embedding``, ``label``) of equal label: ``vec_id``, ``n_links`` (other
    vectors of cosine ``least`` or more), ``component_id`` (smallest id reachable over links), ``kept``.

    Equal vectors of a label are one class and never meet as pairs. A label's classes are dealt to shards of about
    ``shard_rows`` (fewer where vectors are so long that a shard would exceed ``shard_values`` components); each shard gets a
    graph, and every class queries every shard of its label, pair of shards by pair. Beams are widened until ``audit`` queries
    of each pair of shards, all where it has no more, lose no link that a scan finds. Links are counted, and joined to
    components, where they are found: they are never listed as pairs.

    Defined cases: vectors that are null, zero or hold null or non-finite components, and rows without label or id, are linked
    with nothing and kept; vectors of different length are not linked; rows that repeat an id are vectors of their own, linked
    with each other if their vectors are near; an empty table gives none; other columns are ignored.
    """
    rows, classes = _classes(vectors)
    links = pair_links(shard_pairs(classes, shard_rows, shard_values), least, audit)
    counts = links.where("many is not null").groupBy("node").agg(F.sum("many").alias("many"))
    found = components(links.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    held = classes.select("node", "key", "first_id", "n").join(counts, "node", "left").join(found, "node", "left")
    held = written(held.withColumn("component", F.coalesce("component", "node")), "vector-components")
    firsts = held.groupBy("component").agg(F.min("first_id").alias("component_id"))
    held = written(
        held.join(firsts, "component").select("key", "component_id", (F.col("n") - 1 + F.coalesce("many", F.lit(0))).alias("links")), "vector-results"
    )
    alone = rows.where("key is null").select("vec_id", F.lit(None).cast("long").alias("links"), F.lit(None).cast(held.schema["component_id"].dataType).alias("component_id"))
    labelled = rows.where("key is not null").join(held, "key").select("vec_id", "links", "component_id").unionByName(alone)
    return labelled.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
