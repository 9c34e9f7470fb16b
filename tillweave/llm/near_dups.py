"""Near duplicates: MinHash signatures, an LSH forest of sorted signature orders, links confirmed on full shingle sets."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.llm.tables import few, partitions, written

_TREES, _DEPTH, _LEAST = 12, 10, 3  # orders; hashes in each; shortest common prefix that makes neighbours
_REGION = 64  # rows of a region that are compared with each other at once; larger ones go deeper, then block by block
_BLOCK_ROWS, _BLOCK_SHINGLES = 512, 1 << 20  # of a crowded region's block, about
_HASHES = _TREES * _DEPTH
_SURE = 0.95  # estimated likeness from which a row needs no neighbour besides the region's first
_MARGIN = 0.15  # an estimate this far below the threshold is 4 standard errors off
_FACTORS = np.random.default_rng(20).integers(1, 2**63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Set while pairs are confirmed: filter the texts' side whatever its size; at most 8 MB of bits.
_RUNTIME_FILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "67108864",
}
_PLACES = np.random.default_rng(21).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64)
    begins = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(begins, append=len(at))
    offset = np.arange(len(at)) - np.repeat(begins, lengths)
    powers = np.ones(int(lengths.max()), np.uint64)
    powers[1:] = np.cumprod(np.full(len(powers) - 1, _BASE, np.uint64))
    return _mixed(np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * powers[offset], begins))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of all words as one run where there are fewer; none without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    many = len(words) - width + 1
    total = np.full(many, width, np.uint64)
    for i in range(width):
        total += words[i : i + many] * _PLACES[i]
    return np.unique(_mixed(total))


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set, mixed down to 16 bits."""
    least = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[None, low : low + 1024] * _FACTORS[:, None]).min(axis=1), out=least)
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Per document: size and two digests of its shingle set, forest keys (16 bits a hash) and a sketch (4 bits a hash)."""
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("digest", T.LongType()),
            T.StructField("digest2", T.LongType()),
            T.StructField("keys", T.BinaryType()),
            T.StructField("sketch", T.BinaryType()),
        ]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, width)
                least = minhashes(found)
                nibbles = (least & 15).astype(np.uint8)
                digests = [int(x.sum(dtype=np.uint64).view(np.int64)) for x in (found, _mixed(found ^ _BASE))]
                rows.append((len(found), *digests, least.astype(">u2").tobytes(), (nibbles[::2] << 4 | nibbles[1::2]).tobytes()))
            columns = list(zip(*rows)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types)], names=schema.fieldNames()
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, schema)


def _likeness(sketches: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated likeness from 4-bit sketches; one in sixteen unequal hashes agrees by chance."""
    found = np.empty(len(a))
    for low in range(0, len(a), 1 << 16):
        differ = sketches[a[low : low + (1 << 16)]] ^ sketches[b[low : low + (1 << 16)]]
        same = ((differ & 0xF0) == 0).sum(axis=1) + ((differ & 0x0F) == 0).sum(axis=1)
        found[low : low + (1 << 16)] = (same / _HASHES - 1 / 16) * (16 / 15)
    return found


def neighbours(tree: np.ndarray, keys: np.ndarray, node: np.ndarray, size: np.ndarray, sketch: np.ndarray, percent: int):
    """Candidate pairs of one stretch of a sorted order: (row, row, estimated likeness).

    Rows whose keys share at least ``_LEAST`` hashes form a region. A region of up to ``_REGION`` rows is compared in full. A
    larger one links each row to its first document and to the next row in order, and is looked at one hash deeper, where it
    falls apart, until its parts are small: the depth adapts to how crowded the region is. Pairs stay if sizes allow the
    threshold and the estimate is not clearly below it. What this leaves out of a large region is up to ``crowded_links``.
    """
    n = len(node)
    equal = (keys[1:] == keys[:-1]) & (tree[1:] == tree[:-1])[:, None]
    shared = np.cumprod(equal, axis=1, dtype=np.int8).sum(axis=1) if n > 1 else np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fits = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        fits &= node[a] != node[b]
        score = np.zeros(len(a))
        score[fits] = _likeness(sketch, a[fits], b[fits])
        ok = score >= percent / 100 - _MARGIN
        found.append((a[ok], b[ok], score[ok]))
        return score

    active = np.ones(n, bool)  # rows whose region is still too large
    sure = np.zeros(n, bool)
    for depth in range(_LEAST, _DEPTH + 1):
        begins = np.flatnonzero(np.concatenate([[True], shared < depth])) if n else np.zeros(0, np.int64)
        counts = np.diff(begins, append=n)
        region = np.repeat(np.arange(len(begins)), counts)
        many = counts[region]
        small = active & (many > 1) & (many <= _REGION)
        for step in range(1, int(many[small].max()) if small.any() else 1):
            a = np.flatnonzero(small[:-step] & (region[:-step] == region[step:]))
            keep(a, a + step)
        active &= many > _REGION
        if not active.any():
            break
        first = np.lexsort((node, region))[begins]  # smallest document of each region
        a = np.flatnonzero(active & ~sure)
        score = keep(a, first[region[a]])
        sure[a[score >= _SURE]] = True
        last = depth == _DEPTH
        a = np.flatnonzero(active[:-1] & (region[:-1] == region[1:]) & ~(sure[:-1] & sure[1:])) if last or depth == _LEAST else a[:0]
        keep(a, a + 1)
    a, b, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    return a, b, score


def _region(keys: np.ndarray) -> np.ndarray:
    """The first ``_LEAST`` hashes of keys as a number."""
    number = np.zeros(len(keys), np.int64)
    for i in range(_LEAST):
        number = number << 16 | keys[:, i].astype(np.int64)
    return number


def candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a`` < ``b`` of nodes that are neighbours in some order of the forest, with their best estimate; and the
    regions (``tree``, ``region``: the first hashes as a number) whose rows were not all compared with each other.

    All orders are one range-sorted table, so a crowded region spreads over many tasks. A region was not compared in full
    if it has more than ``_REGION`` rows or a partition ends inside it; each task reports those it cannot rule out.
    """
    spark = classes.sparkSession
    order = [
        F.struct(F.lit(t).alias("tree"), F.expr(f"substring(keys, {1 + 2 * _DEPTH * t}, {2 * _DEPTH})").alias("key"))
        for t in range(_TREES)
    ]
    rows = classes.select("node", "n_shingles", "sketch", F.explode(F.array(*order)).alias("at"))
    rows = rows.select(F.col("at.tree").alias("tree"), F.col("at.key").alias("key"), "node", "n_shingles", "sketch")
    ranged = rows.repartitionByRange(partitions(spark), "tree", "key", "node").sortWithinPartitions("tree", "key", "node")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        n = table.num_rows
        tree, node, size = (table.column(c).to_numpy() for c in ("tree", "node", "n_shingles"))
        keys = np.frombuffer(b"".join(table.column("key").to_pylist()), ">u2").reshape(n, _DEPTH)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(n, _HASHES // 2)
        a, b, score = neighbours(tree, keys, node, size, sketch, percent)
        low, high = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        pairs, at = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True)
        number = _region(keys)
        begins = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (tree[1:] != tree[:-1])]))
        counts = np.diff(begins, append=n)
        open_ = counts > _REGION
        open_[[0, -1]] = True  # may go on in the next partition
        begins, counts = begins[open_], counts[open_]
        absent = lambda kind, many: pa.nulls(many, kind)
        for columns in (
            [pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), pa.array(score[at], pa.float64())]
            + [absent(kind, len(pairs)) for kind in (pa.int32(), pa.int64(), pa.int64())],
            [absent(kind, len(begins)) for kind in (pa.int64(), pa.int64(), pa.float64())]
            + [pa.array(x, k) for x, k in ((tree[begins], pa.int32()), (number[begins], pa.int64()), (counts, pa.int64()))],
        ):
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "likeness", "tree", "region", "held"])

    schema = "a long, b long, likeness double, tree int, region long, held long"
    found = written(ranged.mapInArrow(find, schema), "near-found")
    pairs = found.where("tree is null").groupBy("a", "b").agg(F.max("likeness").alias("likeness"))
    regions = found.where("tree is not null").groupBy("tree", "region").agg(F.sum("held").alias("held"), F.count(F.lit(1)).alias("parts"))
    return pairs, regions.where((F.col("held") > _REGION) | (F.col("parts") > 1)).select("tree", "region")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose documents' full shingle sets meet the threshold.

    Both texts of a pair are brought together by one join on the id; a document in many pairs is a hot key of a plain join
    that adaptive execution splits. Spark's own runtime filter, a Bloom filter of bounded size over the pairs' ids, keeps
    texts that no pair asks for out of the shuffle; the predicate on the pairs, always true, is what makes Spark consider it.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = functools.lru_cache(maxsize=8)(lambda text: shingle_set(text, width))
        for batch in batches:
            ok = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = of(left or ""), of(right or "")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(len(x) > 0 and len(y) > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = written(pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id")), "near-sides").where("a < b")
    sides = wanted.join(texts, "doc_id")
    both = sides.groupBy("a", "b").agg(
        F.max(F.when(F.col("doc_id") == F.col("a"), F.col("text"))).alias("left"),
        F.max(F.when(F.col("doc_id") == F.col("b"), F.col("text"))).alias("right"),
    )
    spark = docs.sparkSession
    before = {key: spark.conf.get(key, None) for key in _RUNTIME_FILTER}
    for key, value in _RUNTIME_FILTER.items():
        spark.conf.set(key, value)
    try:
        return written(both.mapInArrow(check, "a long, b long"), "near-confirmed")
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _sets(nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The shingle set of each of the classes ``nodes`` (``node``, ``digest``, ``digest2``), from a text that has it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, digest, digest2, texts = (c.to_pylist() for c in batch.columns)
            held = [shingle_set(t, width) for t in texts]
            sums = [tuple(int(x.sum(dtype=np.uint64).view(np.int64)) for x in (h, _mixed(h ^ _BASE))) for h in held]
            ok = [at for at, pair in enumerate(zip(digest, digest2)) if sums[at] == pair]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node[i] for i in ok], pa.int64()), pa.array([held[i].tobytes() for i in ok], pa.binary())], names=["node", "held"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    found = texts.join(few(nodes), "node").select("node", "digest", "digest2", "text").mapInArrow(read, "node long, held binary")
    return found.groupBy("node").agg(F.min("held").alias("held"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """How many values each wanted pair of sets (rows of ``left``, columns of ``right``) has in common; exact."""
    both = np.zeros(wanted.shape, np.float32)
    a, b = np.nonzero(wanted)
    if len(a) <= 1_000:
        for i, j in zip(a, b):
            both[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
        return both
    flat = [np.concatenate(x) for x in (left, right)]
    shared = np.intersect1d(*flat)  # what only one side has adds nothing
    places = []
    for x, sets in zip(flat, (left, right)):
        at = np.minimum(np.searchsorted(shared, x), max(0, len(shared) - 1))
        hit = shared[at] == x if len(shared) else np.zeros(len(x), bool)
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]
        order = np.argsort(at, kind="stable")
        places.append((row[order], at[order]))
    for low in range(0, len(shared), 2048):
        marks = []
        for (row, at), many in zip(places, wanted.shape):
            begin, end = np.searchsorted(at, [low, low + 2048])
            mark = np.zeros((many, min(2048, len(shared) - low)), np.float32)
            mark[row[begin:end], at[begin:end] - low] = 1
            marks.append(mark)
        both += marks[0] @ marks[1].T
    return both


def crowded_links(classes: DataFrame, regions: DataFrame, found: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The links (``a``, ``b``) between different components ``found`` so far inside ``regions``: all of them, none estimated.

    Within a region the rows of its largest component need no comparison with each other. All other pairs are compared on
    their full sets: both sides are cut into blocks by a hash of the node, and each pair of blocks is a task's group of its
    own, so a large region spreads over tasks. A pair that shares several regions is compared in the first of them.
    """
    numbers = [
        F.struct(
            F.lit(t).alias("tree"),
            F.conv(F.hex(F.expr(f"substring(keys, {1 + 2 * _DEPTH * t}, {2 * _LEAST})")), 16, 10).cast("long").alias("region"),
        )
        for t in range(_TREES)
    ]
    rows = classes.select("node", "n_shingles", F.explode(F.array(*numbers)).alias("at"))
    rows = rows.select("node", "n_shingles", "at.*").join(few(regions), ["tree", "region"])
    rows = written(rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-crowded")
    at = ["tree", "region"]
    parts = rows.groupBy(*at, "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    sizes = parts.groupBy(*at).agg(
        F.max_by("component", F.struct("n", "component")).alias("major"),
        F.max(F.struct("n", "component", "shingles")).alias("most"),
        F.sum("n").alias("n"),
        F.sum("shingles").alias("shingles"),
    )
    blocks = lambda n, shingles: F.ceil(F.greatest(n / _BLOCK_ROWS, shingles / _BLOCK_SHINGLES)).cast("int")
    sizes = written(
        sizes.where("n > most.n").select(
            *at,
            "major",
            blocks(F.col("most.n"), F.col("most.shingles")).alias("majors"),
            blocks(F.col("n") - F.col("most.n"), F.col("shingles") - F.col("most.shingles")).alias("minors"),
        ),
        "near-regions",
    )
    rows = written(rows.join(few(sizes), at), "near-mixed")
    if rows.isEmpty():
        return found.select(F.col("node").alias("a"), F.col("component").alias("b")).limit(0)
    own = rows.groupBy("node").agg(F.sum(F.expr("shiftleft(1, tree)")).cast("int").alias("trees"))
    nodes = written(own.join(classes.select("node", "digest", "digest2", "keys"), "node"), "near-crowded-nodes")
    sets = _sets(nodes.select("node", "digest", "digest2"), docs, width).join(nodes.select("node", "trees", "keys"), "node")
    sets = written(sets, "near-crowded-sets")
    # Blocks 0 to minors - 1 are those of the other components, the rest those of the largest one, which skip each other.
    minor = F.col("component") != F.col("major")
    block = F.when(minor, F.pmod(F.xxhash64("node"), "minors")).otherwise(F.col("minors") + F.pmod(F.xxhash64("node"), "majors")).cast("int")
    every = F.when(minor, F.sequence(F.lit(0), F.col("minors") + F.col("majors") - 1)).otherwise(F.sequence(F.lit(0), F.col("minors") - 1))
    placed = rows.withColumn("block", block).withColumn("other", F.explode(every))
    placed = placed.select(
        "node", "component", *at, "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")
    ).join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        tree, left, right = (table.column(c)[0].as_py() for c in ("tree", "left", "right"))
        block, node, component, trees = (table.column(c).to_numpy() for c in ("block", "node", "component", "trees"))
        held = [np.frombuffer(x, np.uint64) for x in table.column("held").to_pylist()]
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), ">u2").reshape(len(node), _TREES, _DEPTH)
        size = np.array([len(x) for x in held], np.int64)
        x, y = np.flatnonzero(block == left), np.flatnonzero(block == right)
        wanted = component[x][:, None] != component[y][None]
        wanted &= 100 * np.minimum(size[x][:, None], size[y][None]) >= percent * np.maximum(size[x][:, None], size[y][None])
        if left == right:
            wanted = np.triu(wanted, 1)
        for t in range(tree):
            number, mine = _region(keys[:, t]), trees >> t & 1 == 1
            wanted &= ~((number[x][:, None] == number[y][None]) & mine[x][:, None] & mine[y][None])
        x, y, wanted = x[wanted.any(axis=1)], y[wanted.any(axis=0)], wanted[wanted.any(axis=1)][:, wanted.any(axis=0)]
        ok = wanted
        if wanted.size:
            both = overlaps([held[i] for i in x], [held[i] for i in y], wanted).astype(np.int64)
            ok = wanted & (100 * both >= percent * (size[x][:, None] + size[y][None] - both))
        a, b = (node[side[at]] for side, at in zip((x, y), np.nonzero(ok)))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return written(placed.groupBy(*at, "left", "right").applyInArrow(compare, "a long, b long"), "near-crowded-links")


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each linked node (``node``, ``component``).

    Every round takes the smallest label among a node's neighbours and then that node's own label, so labels travel twice as
    far each time. A round's labels are written, which cuts the lineage; only whether labels changed comes to the driver.
    """
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = written(edges.union(edges.select("v", "u")).distinct(), "near-edges")
    labels = written(
        edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component")), "near-labels"
    )
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("heard"))
        nearest = labels.join(heard, "node").select("node", "component", F.least("component", "heard").alias("nearer"))
        ahead = labels.select(F.col("node").alias("nearer"), F.col("component").alias("ahead"))
        stepped = nearest.join(ahead, "nearer").select(
            "node", F.least("nearer", "ahead").alias("component"), (F.least("nearer", "ahead") < F.col("component")).alias("moved")
        )
        stepped = written(stepped, "near-labels")
        labels = stepped.select("node", "component")
        if stepped.where("moved").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near copies: documents are linked if their sets of ``width``-word shingles share ``percent`` in a hundred.

    Returns per row of ``docs`` (``doc_id``, ``text``; other columns are ignored) ``doc_id``, ``n_shingles``, ``class_id``
    (smallest id with exactly the same set), ``component_id`` (smallest id reachable over links), ``kept`` (the row's id is
    its component's). Documents with equal sets fall into one class by their sets' digests and never meet as pairs. Of the
    candidate pairs, each document's likeliest one is confirmed first; what then lies in one component needs no further
    comparison, and all other pairs are confirmed as well. None is dropped. In regions of the forest too crowded to propose
    every pair, all pairs that still lie in different components are then compared on their full sets.

    Defined cases: null, empty and blank texts have an empty set and are linked with nothing; texts of fewer words are one
    shingle; a row that repeats id and text joins its class, one that repeats an id with another text is grouped by its own
    set (a link is confirmed on the id's last text in order); a row without an id is linked with nothing, has no component
    and is kept; an empty table gives none.
    """
    signed = written(signatures(docs, width), "near-signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "digest", "digest2"]
    classes = written(
        some.groupBy(*key).agg(F.min("doc_id").alias("node"), F.min("keys").alias("keys"), F.min("sketch").alias("sketch")),
        "near-classes",
    )
    pairs, regions = candidates(classes, percent)
    pairs, regions = written(pairs, "near-pairs"), written(regions, "near-open-regions")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("likeness", -F.col("a"))).alias("a")).select("a", "b")
    first = confirmed(best, docs, width, percent)
    found = components(first)
    of_a = found.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    of_b = found.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    apart = (
        pairs.join(best, ["a", "b"], "left_anti")
        .join(of_a, "a", "left")
        .join(of_b, "b", "left")
        .where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
        .select("a", "b")
    )
    more = confirmed(apart, docs, width, percent)
    links = first.union(more)
    if not more.isEmpty():
        found = components(links)
    crowded = crowded_links(classes, regions, found, docs, width, percent)
    if not crowded.isEmpty():
        found = components(links.union(crowded))
    members = signed.join(classes.select(*key, "node"), key, "left").select("doc_id", "n_shingles", "node")
    labelled = members.join(found, "node", "left")
    return labelled.select(
        "doc_id",
        "n_shingles",
        F.coalesce("node", "doc_id").alias("class_id"),
        F.coalesce("component", "node", "doc_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, unchanged, but for near copies: of each group of ``near_duplicates`` one row stays.

    Rows are told apart by a key of their own, written beside them, so every row is grouped by its own text and dropped by
    itself, whatever its id. The row that stays is the one with the smallest id; a row without an id stays only if all of its
    group lack one, and of rows that share the smallest id the first as written stays. Only keys meet in joins and groups;
    texts are read once more and lose the dropped keys.

    Defined cases: null, empty and blank texts are near copies of nothing and all stay; a row that repeats a text is a copy,
    with the same id, another or none; a row that repeats an id with another text is judged by that text; any column names
    may occur, as rows travel as one struct; an empty table gives an empty one.
    """
    keyed = written(docs.select(F.struct("*").alias("document"), F.monotonically_increasing_id().alias("row")), "near-rows")
    texts = keyed.select(F.col("row").alias("doc_id"), F.col("document.text").alias("text"))
    found = near_duplicates(texts, width=width, percent=percent).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    found = written(found, "near-grouped")
    ids = keyed.select("row", F.col("document.doc_id").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    stay = found.join(ids, "row").groupBy("component").agg(F.min_by("row", order).alias("row"))
    dropped = written(found.join(stay, "row", "left_anti").select("row"), "near-dropped")
    return keyed.join(few(dropped), "row", "left_anti").select("document.*")
