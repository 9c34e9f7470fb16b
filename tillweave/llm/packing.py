"""Pack documents into sequences of a fixed number of tokens: bulk-synchronous best fit over range-sorted lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.llm.encoding import SMALL, encoder
from tillweave.llm.tables import partitions, written


def cut_lengths(n: int, most: int) -> list[int]:
    """Lengths of a document's pieces: whole ones of ``most`` tokens, the first takes what is over."""
    over = n % most
    return ([over] if over else []) + [most] * (n // most)


def token_pieces(
    docs: DataFrame, tokenizer: str, *, most: int = 2048, end_id: int = 0, with_ids: bool = False, cache: tuple[int, int] = SMALL
) -> DataFrame:
    """Encode whole texts (null: empty), end each with ``end_id``, cut only those over ``most`` tokens.

    Returns ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids`` (little-endian unsigned
    32-bit).
    """
    id_type = docs.schema["doc_id"].dataType
    fields = [
        T.StructField("doc_id", id_type),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ] + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(tokenizer, cache).encode_all
        for batch in batches:
            taken, rows = [], []
            for at, found in enumerate(encode_texts(batch.column(1).to_pylist())):
                ids = found + end
                start = 0
                for number, length in enumerate(cut_lengths(len(ids) // 4, most)):
                    part = ids[4 * start : 4 * (start + length)]
                    taken.append(at)
                    rows.append((number, start, length, zlib.crc32(part), part))
                    start += length
            columns = list(zip(*rows)) or [[]] * 5
            arrays = [batch.column(0).take(pa.array(taken, pa.int64()))]
            arrays += [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            arrays += [pa.array(columns[4], pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(encode, T.StructType(fields))


def sweep(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit of runs of equal lengths: (length, first rank, end rank, first sequence, pieces per sequence, offset).

    One superstep per length, the longest first. All pieces of a length are one run, matched by successor: the run meets
    the smallest gaps that hold it; the k-th piece takes the k-th gap, so ranks settle who gets which; the gaps shrink and
    are there for the next meeting. What finds no gap opens sequences, as many to each as fit. Lengths are integers up to
    ``most``, so there are at most ``most`` runs whatever the number of pieces.
    """
    gaps: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # gap -> runs of (first sequence, sequences)
    sizes = np.zeros(most + 1, dtype=np.int64)  # sequences by gap
    plan: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def release(gap: int, first: int, number: int) -> None:
        if number and gap:
            gaps[gap].append((first, number))
            sizes[gap] += number

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            fitting = np.flatnonzero(sizes[length:])
            if len(fitting):
                gap = length + int(fitting[0])
                first, number = gaps[gap].popleft()
                used = min(number, total - rank)
                sizes[gap] -= number
                if used < number:
                    gaps[gap].appendleft((first + used, number - used))
                    sizes[gap] += number - used
                plan.append((length, rank, rank + used, first, 1, most - gap))
                release(gap - length, first, used)
                rank += used
                continue
            each = most // length
            full, over = divmod(total - rank, each)
            plan.append((length, rank, total, opened, each, 0))
            release(most - each * length, opened, full)
            release(most - over * length, opened + full, 1 if over else 0)
            opened += full + (1 if over else 0)
            rank = total
    return plan


def pack(pieces: DataFrame, *, most: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``most`` tokens (``length``); every other column stays.

    Pieces are range-sorted by length over all partitions, so a frequent length spreads over many; the rank of a piece
    among those of its length is its place in its partition plus what earlier partitions hold. The sweeps work on the
    number of pieces of each length, at most ``most`` rows, and their plan has a few runs per length; each task looks its
    pieces' ranks up in it. Sequences are gapless from 0. Pieces alike in all columns are told apart by rank alone, which
    leaves the result the same. An empty table gives none.
    """
    spark = pieces.sparkSession
    order = [F.col("length")] + [F.col(f"`{c}`") for c in pieces.columns if c in ("doc_id", "piece", "start", "ids_crc32")]
    ranged = written(
        pieces.repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("pack_place", F.monotonically_increasing_id()),
        "pack-ranged",
    )
    part = F.shiftright("pack_place", 33)
    # A row per length and one more per partition at most.
    held = ranged.groupBy(part.alias("part"), "length").agg(F.min("pack_place").alias("low"), F.count(F.lit(1)).alias("n"))
    held = sorted((r["length"], r["part"], r["low"], r["n"]) for r in held.collect())
    counts: dict[int, int] = defaultdict(int)
    shifts = []
    for length, number, low, n in held:
        shifts.append((length, number, counts[length] - low))
        counts[length] += n
    runs = sorted(sweep(dict(counts), most))
    plan = np.array(runs, dtype=np.int64).reshape(-1, 6)
    shift = np.array(shifts, dtype=np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast((plan, shift))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, shift = shared.value
        plan_keys = plan[:, 0] * (1 << 48) + plan[:, 1]
        shift_keys = shift[:, 0] * (1 << 32) + shift[:, 1]
        for batch in batches:
            names = batch.schema.names
            length = np.asarray(batch.column(names.index("length")).to_numpy(zero_copy_only=False), np.int64)
            at = np.asarray(batch.column(names.index("pack_place")).to_numpy(zero_copy_only=False), np.int64)
            rank = at + shift[np.searchsorted(shift_keys, length * (1 << 32) + (at >> 33)), 2] if len(at) else at
            run = plan[np.searchsorted(plan_keys, length * (1 << 48) + rank, side="right") - 1] if len(at) else np.zeros((0, 6), np.int64)
            ahead = rank - run[:, 1]
            each = np.maximum(run[:, 4], 1)
            added = [pa.array(run[:, 3] + ahead // each, pa.int64()), pa.array(run[:, 5] + ahead % each * length, pa.int64())]
            kept = [c for n, c in zip(names, batch.columns) if n != "pack_place"]
            yield pa.RecordBatch.from_arrays(kept + added, names=[n for n in names if n != "pack_place"] + ["sequence_id", "offset"])

    schema = T.StructType(
        [f for f in ranged.schema if f.name != "pack_place"]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    return ranged.mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, *, most: int = 2048, end_id: int = 0, with_ids: bool = False, cache: tuple[int, int] = SMALL
) -> DataFrame:
    """Encode and pack documents; one row per piece. ``cache`` bounds the encoder's caches (entries of words and of parts).

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null and empty texts are one token (the end id);
    rows with equal or null ids are packed like any other.
    """
    pieces = written(token_pieces(docs, tokenizer, most=most, end_id=end_id, with_ids=with_ids, cache=cache), "pack-pieces")
    return pack(pieces, most=most)
