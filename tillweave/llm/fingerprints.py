"""Document fingerprints by order MinHash: minimal occurrence-numbered k-mers, kept in text order, hashed as tuples."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.llm.tables import partitions, written

KMER, TUPLE, SKETCHES = 6, 2, 64  # code points of a k-mer; k-mers of a tuple; tuples of a fingerprint
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POINTS = (np.arange(SKETCHES, dtype=np.uint64) << np.uint64(58)) + np.uint64(0x0123456789ABCDE)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def fingerprint(text: str) -> bytes:
    """64 tuple hashes of 16 bits.

    Each k-mer is hashed together with its occurrence number, so repeats count. Hashes lie on a circle; sketch i takes the
    ``TUPLE`` hashes that follow point i (the next hash after a fixed point is a uniformly chosen element, as the minimum of
    a random order is), puts them in text order and hashes the tuple. A text shorter than a k-mer is one k-mer.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n = max(1, len(code) - KMER + 1)
    kmer = np.zeros(n, np.uint64)
    for i in range(min(KMER, len(code))):
        kmer = kmer * _BASE + code[i : i + n]
    kmer = _mixed(kmer)
    places = np.uint64(max(1, n - 1).bit_length())
    low = np.uint64((1 << int(places)) - 1)
    # sorted by (hash, place): equal k-mers lie side by side in text order
    ordered = np.sort((kmer & ~low) | np.arange(n, dtype=np.uint64))
    place = (ordered & low).astype(np.int64)
    group = ordered & ~low
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    number = np.arange(n) - np.repeat(begins, np.diff(begins, append=n))
    numbered = np.empty(n, np.uint64)
    numbered[place] = _mixed(kmer[place] + number.astype(np.uint64) * _BASE)
    circle = np.sort((numbered & ~low) | np.arange(n, dtype=np.uint64))
    at = np.searchsorted(circle, _POINTS)
    chosen = (circle[(at[:, None] + np.arange(TUPLE)) % n] & low).astype(np.int64)
    chosen.sort(axis=1)
    tuples = np.zeros(SKETCHES, np.uint64)
    for i in range(TUPLE):
        tuples = _mixed(tuples * _BASE + numbered[chosen[:, i]])
    return (tuples >> np.uint64(48)).astype("<u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal tuple hashes: an estimate that falls with the edit distance."""
    return float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())


def edited(text: str, following: str) -> str:
    """The last quarter of a text's code points replaced by as many (or all) first ones of the text that follows."""
    over = len(text) // 4
    return text[: len(text) - over] + following[:over]


_PAIR = T.StructType(
    [
        T.StructField("edited_sha256", T.BinaryType()),
        T.StructField("edited_fingerprint", T.BinaryType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def _compared(text: str, mark: bytes, following: str, following_mark: bytes) -> tuple[bytes, bytes, float, float]:
    changed = edited(text, following)
    changed_mark = fingerprint(changed)
    return (
        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(),
        changed_mark,
        likeness(mark, changed_mark),
        likeness(mark, following_mark),
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, with how alike they and the next document's are.

    The next document is the one with the next higher ``doc_id``, the first one for the last. Documents are range-sorted by
    id once; a task walks its range in order and hands on, beside its finished rows, its first and its last document, whose
    neighbours lie in other ranges: one such row per partition, joined to the next one.

    Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (lowercase hex),
    ``near_edited``, ``near_next``. Defined cases: a null text is empty; texts without a k-mer's length are one k-mer; equal
    texts have equal fingerprints and likeness 1; rows with equal ids follow each other in text order, those without an id
    come last; a single document follows itself; other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    schema = T.StructType(
        [id_field, T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.BinaryType()), *_PAIR.fields]
        + [T.StructField(c, T.StringType()) for c in ("first_text", "last_text")]
        + [T.StructField("first_mark", T.BinaryType())]
    )
    order = [F.col("doc_id").asc_nulls_last(), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))]
    ranged = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order, "text")
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple[str, bytes] | None = None
        held: tuple | None = None  # the document whose next one has not come yet
        arrow = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.binary()]

        def block(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names=schema.fieldNames())

        for batch in batches:
            arrow[0] = batch.column(0).type
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mark = fingerprint(text)
                if held is None:
                    first = (text, mark)
                else:
                    rows.append((held[0], len(held[1]), held[2], *_compared(held[1], held[2], text, mark), None, None, None))
                held = (doc_id, text, mark)
            if rows:
                yield block(rows)
        if held is not None:
            yield block([(held[0], len(held[1]), held[2], None, None, None, None, first[0], held[1], first[1])])

    walked = written(ranged.mapInArrow(walk, schema).withColumn("part", F.spark_partition_id()), "fingerprints")
    inner = walked.where("first_mark is null")
    # One row per partition: which partition comes next, and then its first document.
    edge = walked.where("first_mark is not null")
    by_part = Window.orderBy("part")
    turns = edge.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy())))
    heads = edge.select(F.col("part").alias("next_part"), F.col("first_text").alias("next_text"), F.col("first_mark").alias("next_mark"))
    joined = edge.join(turns, "part").join(heads, "next_part")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_compared(*r) for r in zip(*(c.to_pylist() for c in batch.columns[3:]))]
            columns = list(zip(*rows)) or [[]] * 4
            types = (pa.binary(), pa.binary(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(batch.columns[:3] + [pa.array(c, t) for c, t in zip(columns, types)], names=out.fieldNames())

    out = T.StructType(schema.fields[:7])
    met = joined.select("doc_id", "n_chars", "fingerprint", "last_text", "fingerprint", "next_text", "next_mark")
    met = met.toDF("doc_id", "n_chars", "fingerprint", "last_text", "mark", "next_text", "next_mark").mapInArrow(meet, out)
    whole = inner.select(*out.fieldNames()).unionByName(met)
    text = {c: F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return whole.select(*[text.get(c, F.col(c)) for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")])
