"""Vector codes: product quantization in exact integers, over Hilbert-sorted blocks with boxes and sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.llm.tables import partitions, written

_BITS = 4  # of a Hilbert curve's grid, per dimension


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & ok, F.lit(False))


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of the parts of a vector: equal ones, the first of them longer by one where they cannot be."""
    ends = np.cumsum([width // parts + (i < width % parts) for i in range(parts)])
    return [(int(e) - (width // parts + (i < width % parts)), int(e)) for i, e in enumerate(ends)]


def hilbert_keys(cells: np.ndarray, bits: int = _BITS) -> list[bytes]:
    """Position of grid cells [points, dimensions] on the Hilbert curve, as byte strings in curve order."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    if not n:
        return [b""] * len(x)
    level = 1 << (bits - 1)
    while level > 1:  # undo the rotations and reflections of each level
        below = level - 1
        for i in range(n):
            high = (x[:, i] & level) > 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] = np.where(high, x[:, 0] ^ below, x[:, 0]) ^ swap
            x[:, i] ^= np.where(high & (i == 0), 0, swap)
        level >>= 1
    for i in range(1, n):  # Gray code
        x[:, i] ^= x[:, i - 1]
    flip, level = np.zeros(len(x), np.int64), 1 << (bits - 1)
    while level > 1:
        flip ^= np.where(x[:, n - 1] & level, level - 1, 0)
        level >>= 1
    x ^= flip[:, None]
    planes = (x[:, None, :] >> np.arange(bits - 1, -1, -1)[None, :, None]) & 1  # the highest bit of every dimension first
    return [row.tobytes() for row in np.packbits(planes.reshape(len(x), -1).astype(np.uint8), axis=1)]


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, width)


def _extent(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each component, from one row per task."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(0), width)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(low), pa.array(high)], names=["at", "low", "high"])

    found = rows.select("v").mapInArrow(measure, "at int, low long, high long").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ends = found.orderBy("at").collect()  # one row per component
    return np.array([r.low for r in ends], np.int64), np.array([r.high for r in ends], np.int64)


def blocks_of(rows: DataFrame, width: int, parts: int, low: np.ndarray, high: np.ndarray, block_rows: int) -> DataFrame:
    """The parts of all vectors in Hilbert order, cut into flat blocks: ``part``, ``rows``, ``v`` (the values one after the
    other), ``low`` and ``high`` (the block's box), ``total`` (its sums), ``n``.

    Equal parts are ordered by row, so that a value which many vectors have spreads over partitions and blocks.
    """
    spans = cuts(width, parts)
    span = np.maximum(high - low, 1)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(1), width)
            cells = ((x - low) / span * (1 << _BITS)).astype(np.int64).clip(0, (1 << _BITS) - 1)
            for part, (begin, end) in enumerate(spans):
                piece = np.ascontiguousarray(x[:, begin:end])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(x), part, np.int32)),
                        pa.array(hilbert_keys(cells[:, begin:end]), pa.binary()),
                        batch.column(0),
                        pa.array([p.tobytes() for p in piece], pa.binary()),
                    ],
                    names=["part", "key", "row", "v"],
                )

    widths = [end - begin for begin, end in spans]
    order = ("part", "key", "row")
    points = rows.select("row", "v").mapInArrow(split, "part int, key binary, row long, v binary")
    ranged = points.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            row = batch.column(2).to_numpy()
            v = batch.column(3).to_pylist()
            turns = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            found = []
            for begin, end in zip(turns, turns[1:]):
                for at in range(begin, end, block_rows):
                    to = min(at + block_rows, end)
                    x = np.frombuffer(b"".join(v[at:to]), np.int64).reshape(to - at, widths[part[at]])
                    box = [f.tobytes() for f in (x.min(axis=0), x.max(axis=0), x.sum(axis=0))]
                    found.append((int(part[at]), row[at:to].astype(np.int64).tobytes(), x.tobytes(), *box, to - at))
            columns = list(zip(*found)) or [[]] * 7
            types = (pa.int32(), *[pa.binary()] * 5, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "rows", "v", "low", "high", "total", "n"])

    return written(ranged.mapInArrow(cut, "part int, rows binary, v binary, low binary, high binary, total binary, n long"), "codes-blocks")


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries that can be nearest to some point of a box: no farther from it at best than some entry is at worst."""
    best = np.maximum(np.maximum(low - book, book - high), 0)
    worst = np.maximum(np.abs(low - book), np.abs(high - book))
    best, worst = (best * best).sum(axis=1), (worst * worst).sum(axis=1)
    return np.flatnonzero(best <= worst.min())


def nearest(x: np.ndarray, book: np.ndarray, exact_float: bool) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each point (the first of equally near ones) and its squared distance, exact.

    Products of small enough integers are exact in floating point, which multiplies matrices faster.
    """
    kind = np.float64 if exact_float else np.int64
    a, b = x.astype(kind), book.astype(kind)
    apart = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]
    at = apart.argmin(axis=1)
    return at, apart[np.arange(len(x)), at].astype(np.int64)


def _read(block: dict, width: int) -> tuple[np.ndarray, ...]:
    low, high, total = (np.frombuffer(block[c], np.int64) for c in ("low", "high", "total"))
    return np.frombuffer(block["v"], np.int64).reshape(block["n"], width), low, high, total


def gathered(blocks: DataFrame, books: list[np.ndarray], exact_float: bool) -> DataFrame:
    """Per entry and place: sum of the parts assigned to it, and their number. Each task adds its blocks up first."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(b) for b in books]
        many = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for block in batch.to_pylist():
                part = block["part"]
                book = books[part]
                x, low, high, total = _read(block, book.shape[1])
                short = shortlist(low, high, book)
                if len(short) == 1:  # all of the block goes to one entry
                    sums[part][short[0]] += total
                    many[part][short[0]] += block["n"]
                    continue
                at, _ = nearest(x, book[short], exact_float)
                order = np.argsort(at, kind="stable")
                chosen, begins = np.unique(at[order], return_index=True)
                sums[part][short[chosen]] += np.add.reduceat(x[order], begins, axis=0)
                many[part][short[chosen]] += np.diff(begins, append=len(at))
        for part, (s, m) in enumerate(zip(sums, many)):
            used = np.flatnonzero(m)
            places = s.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used) * places, part, np.int32)),
                    pa.array(np.repeat(used, places).astype(np.int32)),
                    pa.array(np.tile(np.arange(places), len(used)).astype(np.int32)),
                    pa.array(s[used].ravel()),
                    pa.array(np.repeat(m[used], places)),
                ],
                names=["part", "entry", "place", "total", "n"],
            )

    found = blocks.mapInArrow(gather, "part int, entry int, place int, total long, n long")
    return found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def assigned(blocks: DataFrame, books: list[np.ndarray], exact_float: bool) -> DataFrame:
    """Entry and squared distance of every part of every row: ``row``, ``part``, ``entry``, ``error``."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                book = books[block["part"]]
                x, low, high, _ = _read(block, book.shape[1])
                short = shortlist(low, high, book)
                at, error = nearest(x, book[short], exact_float)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(block["rows"], np.int64)), pa.array(np.full(len(x), block["part"], np.int32)), pa.array(short[at].astype(np.int32)), pa.array(error)],
                    names=["row", "part", "entry", "error"],
                )

    return blocks.mapInArrow(assign, "row long, part int, entry int, error long")


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for book in books for c in book.ravel()).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, block_rows: int = 512
) -> DataFrame:
    """Product quantization of ``vectors`` (``vec_id``, ``embedding``, ``label``): ``vec_id``, ``code``, ``error``,
    ``label_error``, ``codebooks_sha256``.

    Components become integers (times ``scale``, rounded down); each part position has a codebook that starts as that part of
    the vectors with the smallest ids and is refined ``rounds`` times: parts go to their nearest entry (ties to the lower), an
    entry becomes the mean of its parts, rounded down. All of it is exact, so it does not depend on partitions. Per round a
    block's box rules out most entries, and a block with one left is added by its stored sums. Only codebooks (``entries``
    vectors) reach the driver.

    Defined cases: vectors that are null or hold null or non-finite components are dropped; a vector of another length than
    that of the smallest id has null code and errors; parts differ by one component where the length does not divide; fewer
    vectors than entries make smaller codebooks; equal ids go by their vectors; rows without an id come last; repeated rows are
    rows of their own; null labels are one label; an empty table gives none. Components too large for distances in 64 bits
    (about 100,000 in 64 dimensions) raise a ValueError before any work.
    """
    spark = vectors.sparkSession
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    kept = vectors.where(finite(F.col("embedding"))).select("vec_id", "label", values.alias("v"))
    kept = written(kept.withColumn("row", F.monotonically_increasing_id()), "codes-vectors")
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    width = len(first[0].v) if first else 0
    if not width:
        return kept.select("vec_id", *[F.lit(None).cast("string" if c in ("code", "codebooks_sha256") else "long").alias(c) for c in ("code", "error", "label_error", "codebooks_sha256")]).to(spark.createDataFrame([], schema).schema)
    fits = kept.where(F.size("v") == width)
    low, high = _extent(fits, width)
    most = int(max(abs(int(low.min())), abs(int(high.max())), 1))
    if 4 * width * most * most >= 1 << 63:
        raise ValueError(f"components up to {most / scale:g} are too large for exact distances in 64 bits")
    exact_float = 8 * width * most * most < 1 << 53
    start = np.array([r.v for r in first if len(r.v) == width], np.int64)
    books = [np.ascontiguousarray(start[:, a:b]) for a, b in cuts(width, parts)]
    blocks = blocks_of(fits, width, parts, low, high, block_rows)
    for _ in range(rounds):
        for r in gathered(blocks, books, exact_float).collect():  # at most one row per entry and place
            books[r.part][r.entry, r.place] = r.total // r.n
    digits = max(2, len(f"{entries - 1:x}"))
    of = assigned(blocks, books, exact_float).groupBy("row").agg(
        *[F.max(F.when(F.col("part") == p, F.col("entry"))).alias(f"entry{p}") for p in range(parts)], F.sum("error").alias("error")
    )
    code = F.concat(*[F.lpad(F.lower(F.hex(F.col(f"entry{p}").cast("long"))), digits, "0") for p in range(parts)])
    coded = written(kept.select("row", "vec_id", "label").join(of.select("row", code.alias("code"), "error"), "row", "left").drop("row"), "codes-coded")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", F.when(F.col("code").isNotNull(), F.col("label_error")).alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256")
    )
