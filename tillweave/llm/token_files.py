"""Token ids in binary shards with a minimal perfect hash index from document key to place, and their reader.

A shard is one file, all numbers little-endian:

    head      8 bytes of magic, then unsigned 64-bit numbers: documents, those with a key, distinct keys, ids, bytes per id,
              hash levels, spilled keys
    payload   ids of all documents one after the other
    starts    unsigned 64-bit, one per document and one more: first id of each document in the payload
    levels    per level an unsigned 64-bit number of bits, then the bits in 64-bit words
    slots     per key: unsigned 32-bit fingerprint, unsigned 32-bit number of the key's first document
    spilled   keys that no level placed (signed 64-bit, sorted); their slots come last, in this order
    keys      signed 64-bit, of the documents that have one, ascending

Keys are spread over the levels' bits by hash: a bit is set where exactly one key falls, the rest go to the next level. The
number of set bits before a key's bit is its slot, so an access costs a few hashes whatever the number of keys; the stored
fingerprint tells keys that were never written.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.llm.encoding import SMALL, encoder
from tillweave.llm.tables import partitions

MAGIC = b"TWIDS1\0\0"
_HEAD = struct.Struct("<8s7Q")
_SLOT = np.dtype([("fingerprint", "<u4"), ("document", "<u4")])
_MANIFEST = pa.schema([("shard", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())])
_SPREAD = 2  # bits per key and level
_LEVELS = 24


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A well-mixed 64-bit hash of each key (multiply and shift, in rounds)."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    for factor, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1_000) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    """Distinct keys to 0 .. n-1, one slot each."""

    bits: list[np.ndarray]  # per level, one bool per bit
    spilled: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, bits = keys.astype(np.int64), []
        while len(left) and len(bits) < _LEVELS:
            size = max(64, -(-_SPREAD * len(left) // 64) * 64)
            at = (_mixed(left, len(bits)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            left = left[~alone[at]]
        return cls(bits, np.sort(left))

    @functools.cached_property
    def ranks(self) -> list[np.ndarray]:
        """Per level and bit, the number of set bits up to it, over all levels."""
        before, ranks = 0, []
        for bits in self.bits:
            ranks.append(before + np.cumsum(bits))
            before = int(ranks[-1][-1])
        return ranks

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; for a key that was not built in, any slot or -1."""
        keys = keys.astype(np.int64)
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            at = (_mixed(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            found[open_[hit]] = ranks[at[hit]] - 1
            open_ = open_[~hit]
        before = int(self.ranks[-1][-1]) if self.bits else 0
        if len(self.spilled) and len(open_):
            at = np.searchsorted(self.spilled, keys[open_])
            ok = (at < len(self.spilled)) & (self.spilled[np.minimum(at, len(self.spilled) - 1)] == keys[open_])
            found[open_[ok]] = before + at[ok]
        return found


def shard_bytes(keys: np.ndarray, lengths: np.ndarray, payload: bytes, width: int) -> bytes:
    """One shard. ``keys`` ascending, repeats allowed: a key's slot names its first document. Documents beyond the keys have none."""
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    distinct, first = np.unique(keys, return_index=True)
    perfect = PerfectHash.build(distinct)
    slots = np.zeros(len(distinct), dtype=_SLOT)
    at = perfect.slots(distinct)
    slots["fingerprint"][at], slots["document"][at] = _fingerprints(distinct), first
    head = _HEAD.pack(MAGIC, len(lengths), len(keys), len(distinct), int(starts[-1]), width, len(perfect.bits), len(perfect.spilled))
    levels = b"".join(struct.pack("<Q", len(b)) + np.packbits(b, bitorder="little").tobytes() for b in perfect.bits)
    sections = [head, payload, starts.tobytes(), levels, slots.tobytes(), perfect.spilled.astype("<i8").tobytes()]
    return b"".join([*sections, keys.astype("<i8").tobytes()])


class Shard:
    """Keyed access to one shard through ``read(offset, size)``: its index is read once, ids only where asked for."""

    def __init__(self, read, size: int):
        head = read(0, _HEAD.size)
        magic, self.documents, n_keyed, n_keys, n_ids, self.width, n_levels, n_spilled = _HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.read = read
        begin = _HEAD.size + n_ids * self.width
        index = read(begin, size - begin)
        self.starts = np.frombuffer(index, "<u8", self.documents + 1).astype(np.int64)
        at, bits = 8 * (self.documents + 1), []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", index, at)
            bits.append(np.unpackbits(np.frombuffer(index, np.uint8, n // 8, at + 8), bitorder="little").astype(bool))
            at += 8 + n // 8
        self.slots = np.frombuffer(index, _SLOT, n_keys, at)
        at += _SLOT.itemsize * n_keys
        self.perfect = PerfectHash(bits, np.frombuffer(index, "<i8", n_spilled, at))
        #: Keys of the documents in order, for reading a shard through; finding a key does without them.
        self.keys = np.frombuffer(index, "<i8", n_keyed, at + 8 * n_spilled)

    @classmethod
    def of_bytes(cls, content: bytes) -> Shard:
        view = memoryview(content)
        return cls(lambda offset, size: view[offset : offset + size], len(content))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key's first document in this shard, -1 where the fingerprint says it is not here."""
        keys = np.asarray(keys, np.int64)
        slot = self.perfect.slots(keys)
        here = slot >= 0
        here[here] = self.slots["fingerprint"][slot[here]] == _fingerprints(keys[here])
        found = np.full(len(keys), -1, np.int64)
        found[here] = self.slots["document"][slot[here]]
        return found

    def ids(self, document: int) -> np.ndarray:
        """The ids of a document of this shard, as unsigned 32-bit numbers."""
        low, high = (self.width * int(s) for s in self.starts[document : document + 2])
        return np.frombuffer(self.read(_HEAD.size + low, high - low), f"<u{self.width}").astype("<u4")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def _place(folder: str, name: str, content: bytes, attempt: int) -> None:
    """Write a file whole: under a name of this attempt first, then renamed, so that a lost task leaves no half file."""
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    part = f"{base}/_{name}.{attempt}"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, f"{base}/{name}")


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 2, shards: int | None = None, cache: tuple[int, int] = SMALL) -> DataFrame:
    """Encode whole texts (null: empty), end each with ``end_id`` and write them by ascending ``doc_id``.

    Documents are range-partitioned by id and each partition writes one shard, so shards hold ascending, disjoint ranges of
    keys. A task holds one shard: take as many ``shards`` as keep that small. Ids are stored in 2 bytes where the vocabulary
    allows it. Equal ids follow each other in text order and the key leads to the first; rows without an id come last and
    have no key. Other columns are ignored; an empty table gives no shard. Returns the manifest, one row per shard:
    ``shard``, ``low`` and ``high`` key, ``documents``, ``tokens``, ``start`` (ids before it).
    """
    spark = docs.sparkSession
    width = 2 if max(encoder(tokenizer).library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    end = np.array([end_id], f"<u{width}").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer, cache).encode_all, TaskContext.get()
        keys, lengths, payload = [], [], bytearray()
        for batch in batches:
            keys += [k for k in batch.column(0).to_pylist() if k is not None]
            for found in encode(batch.column(1).to_pylist()):
                ids = np.frombuffer(found, "<u4").astype(f"<u{width}").tobytes() + end
                lengths.append(len(ids) // width)
                payload += ids
        if not lengths:
            return
        number = task.partitionId()
        content = shard_bytes(np.array(keys, np.int64), np.array(lengths, np.int64), bytes(payload), width)
        _place(folder, _name(number), content, task.taskAttemptId())
        row = (number, keys[0] if keys else None, keys[-1] if keys else None, len(lengths), sum(lengths))
        yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST.names, row))], schema=_MANIFEST)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_last(), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))]
    sorted_ = keyed.repartitionByRange(shards or partitions(spark), *order).sortWithinPartitions(*order, "text")
    done = sorted_.mapInArrow(write, "shard int, low long, high long, documents long, tokens long")
    rows = sorted(tuple(r) for r in done.collect())  # one row per shard
    table = pa.Table.from_pylist([dict(zip(_MANIFEST.names, r)) for r in rows], schema=_MANIFEST)
    start = np.cumsum([0] + [r[4] for r in rows])[:-1]
    sink = pa.BufferOutputStream()
    pq.write_table(table.append_column("start", pa.array(start, pa.int64())), sink)
    _place(folder, "manifest.parquet", sink.getvalue().to_pybytes(), 0)
    return spark.read.parquet(f"{folder}/manifest.parquet")


def _name(shard: int) -> str:
    return f"shard-{shard:06d}.ids"


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start`` (ids of all before it), ``n_tokens``, ``ids_crc32``.

    Each key is fetched through its shard's index; repeats of a key and documents without one follow by place.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.ids").load(folder)
    shard = F.regexp_extract("path", r"shard-(\d+)\.ids$", 1).cast("int")
    manifest = spark.read.parquet(f"{folder}/manifest.parquet").select("shard", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, before in zip(batch.column(0), batch.column(1).to_pylist()):
                shard = Shard.of_bytes(content.as_buffer())
                keys = shard.keys
                first = shard.find(keys)
                if (first < 0).any():
                    raise ValueError("a key is missing in its shard's index")
                place = first + np.arange(len(keys)) - np.searchsorted(keys, keys)
                place = np.concatenate([place, np.arange(len(keys), shard.documents)]).tolist()
                ids = [shard.ids(p) for p in place]
                columns = [
                    pa.array(keys.tolist() + [None] * (shard.documents - len(keys)), pa.int64()),
                    pa.array([before + int(shard.starts[p]) for p in place], pa.int64()),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.select(shard.alias("shard"), "content").join(manifest, "shard")
    return placed.select("content", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Ids of the given keys (first column, a long): ``key`` and ``ids`` (array of long), null where a key was not written.

    Keys are range-partitioned, so a task opens few shards; it reads their indexes once and then only the ids asked for.
    The manifest (a row per shard) tells the shard. A key that was never written passes the fingerprint with odds of one to
    four thousand million.
    """
    rows = spark.read.parquet(f"{folder}/manifest.parquet").where("low is not null").orderBy("low").select("shard", "low", "high").collect()
    bounds = spark.sparkContext.broadcast([tuple(r) for r in rows])
    name = keys.columns[0]

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        lows = np.array([low for _, low, _ in bounds.value], np.int64)
        opened: tuple[int, Shard] | None = None
        for batch in batches:
            asked, got = batch.column(0).to_pylist(), []
            for key in asked:
                at = -1 if key is None else int(np.searchsorted(lows, key, side="right")) - 1
                if at < 0 or key > bounds.value[at][2]:
                    got.append(None)
                    continue
                if opened is None or opened[0] != at:
                    file = store.open_input_file(f"{base}/{_name(bounds.value[at][0])}")
                    opened = at, Shard(lambda offset, size, file=file: file.read_at(size, offset), file.size())
                document = int(opened[1].find(np.array([key]))[0])
                got.append(None if document < 0 else opened[1].ids(document).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(got, pa.list_(pa.int64()))], names=["key", "ids"])

    asked = keys.select(F.col(f"`{name}`").cast("long").alias("key"))
    return asked.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(get, "key long, ids array<long>")
