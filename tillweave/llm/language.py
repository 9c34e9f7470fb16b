"""Language of texts by prediction by partial matching: code lengths under byte context trees, one per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.llm.tables import hash_sample, written

ORDER = 3  # bytes of context at most
UNDETERMINED = "und"


def gram_counts(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of the runs of 1 to ``ORDER`` + 1 bytes, each run as a number (most significant byte first), ascending."""
    found: list[list[np.ndarray]] = [[] for _ in range(ORDER + 1)]
    for text in texts:
        code = np.frombuffer(text, np.uint8).astype(np.int64)
        gram = code
        for k in range(ORDER + 1):
            if k:
                gram = gram[:-1] << 8 | code[k:]
            found[k].append(gram)
    return [np.unique(np.concatenate(g or [np.zeros(0, np.int64)]), return_counts=True) for g in found]


class _Sparse:
    """Values of (code, language) pairs, by code: only pairs that were met take room."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        codes = np.concatenate([c for c, _ in parts])
        languages = np.repeat(np.arange(len(parts), dtype=np.int32), [len(c) for c, _ in parts])
        order = np.argsort(codes, kind="stable")
        self.codes, first = np.unique(codes[order], return_index=True)
        self.ends = np.append(first, len(codes)).astype(np.int64)
        self.languages, self.values = languages[order], np.concatenate([v for _, v in parts])[order]

    def add_to(self, bits: np.ndarray, codes: np.ndarray) -> None:
        """Add the values of each of ``codes`` to its row of ``bits``."""
        if not len(self.codes):
            return
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        rows = np.flatnonzero(self.codes[at] == codes)
        begin, many = self.ends[at[rows]], np.diff(self.ends)[at[rows]]
        here = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
        bits[np.repeat(rows, many), self.languages[here]] += self.values[here]


class ContextTrees:
    """Byte context trees of several languages with frozen counts.

    In a context of length k a byte with count c, among n occurrences of d different bytes, costs -log2(c / (n + d)); an
    unseen one costs the escape -log2(d / (n + d)) and its cost in the context one byte shorter; below the empty context all
    256 bytes are alike. A context that a language never saw costs nothing to leave.

    A byte's cost is therefore 8 bits, and for each of its contexts that the language saw the escape, and for each of those
    in which the language saw the byte what its own code saves against the escape. Only these two kinds of value are kept,
    so a language takes room for what its own sample holds, whatever the other languages hold.
    """

    def __init__(self, counts: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        """``counts``: of each language the ``gram_counts`` of its sample."""
        self.languages = sorted(counts)
        self.escapes: list[_Sparse] = []
        self.savings: list[_Sparse] = []
        shorter = {name: (np.zeros(1, np.int64), np.full(1, 8.0)) for name in self.languages}
        for k in range(ORDER + 1):
            escapes, savings = [], []
            for name in self.languages:
                codes, found = counts[name][k]
                contexts, first, row = np.unique(codes >> 8, return_index=True, return_inverse=True)
                total = np.bincount(row, found, len(contexts))
                kinds = np.diff(np.append(first, len(codes)))
                escape, cost = -np.log2(kinds / (total + kinds)), -np.log2(found / (total + kinds)[row])
                below, cost_below = shorter[name]
                suffix = np.searchsorted(below, codes & (1 << 8 * k) - 1)  # a run's end was met with the run
                escapes.append((contexts, escape))
                savings.append((codes, cost - escape[row] - cost_below[suffix]))
                shorter[name] = codes, cost
            self.escapes.append(_Sparse(escapes))
            self.savings.append(_Sparse(savings))

    @classmethod
    def of(cls, samples: dict[str, list[bytes]]) -> ContextTrees:
        return cls({name: gram_counts(texts) for name, texts in samples.items()})

    def _costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run of ``ORDER`` + 1 bytes, in each language."""
        bits = np.full((len(grams), len(self.languages)), 8.0)
        for k in range(ORDER + 1):
            code = grams & (1 << 8 * (k + 1)) - 1
            self.escapes[k].add_to(bits, code >> 8)
            self.savings[k].add_to(bits, code)
        return bits

    def bits(self, texts: list[bytes], block: int | None = None) -> np.ndarray:
        """Exact code lengths of whole texts in each language (a row per text), to a millionth of a bit.

        The texts are walked end to end in blocks of bytes, the smaller the more languages there are; runs that repeat
        within a block are looked up once. The first bytes of a text have a blank context, as after white space.
        """
        block = block or max(1 << 12, (1 << 22) // len(self.languages))
        total = np.zeros((len(texts), len(self.languages)))
        raw = np.frombuffer(b"".join(b" " * ORDER + text for text in texts), np.uint8)
        ends = np.cumsum([ORDER + len(text) for text in texts])
        starts = np.append(0, ends[:-1])[: len(texts)] + ORDER  # of the texts proper, behind their blanks
        for low in range(0, len(raw), block):
            high = min(low + block, len(raw))
            begin, end = np.clip(starts, low, high), np.clip(ends, low, high)
            inside = np.flatnonzero(end > begin)
            many = (end - begin)[inside]
            if not len(inside):
                continue
            edges = np.cumsum(many) - many
            at = np.repeat(begin[inside] - edges, many) + np.arange(many.sum())
            gram = raw[at - ORDER].astype(np.int64)
            for k in range(ORDER - 1, -1, -1):
                gram = gram << 8 | raw[at - k]
            row, grams = pd.factorize(gram)
            total[inside] += np.add.reduceat(self._costs(grams)[row], edges, axis=0)
        return np.round(total, 6)


def training_sample(docs: DataFrame, lang: Column, learn: Column, per_language: int) -> DataFrame:
    """Whole texts (``sample_lang``, ``sample_text``) of at most ``per_language`` rows of each language, chosen by a hash of
    the id. Ids are chosen without reading texts."""
    labelled = docs.where(learn & lang.isNotNull()).select(
        lang.cast("string").alias("sample_lang"), F.col("doc_id").alias("sample_id"), F.col("text").alias("sample_text")
    )
    chosen = written(hash_sample(labelled, "sample_lang", "sample_id", F.lit(per_language)), "lang-sample")
    rows = labelled.where("sample_text is not null").join(chosen, ["sample_lang", "sample_id"])
    return rows.groupBy("sample_lang", "sample_id").agg(F.min("sample_text").alias("sample_text")).drop("sample_id")


def learned(docs: DataFrame, learn: Column, lang: Column | None, per_language: int) -> ContextTrees | None:
    """Trees of the sample's languages. Tasks count byte runs, and only their sums, one per language and run that its sample
    holds, come to the driver; texts do not."""
    sample = written(training_sample(docs, F.col("lang") if lang is None else lang, learn, per_language), "lang-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                for k, (codes, found) in enumerate(gram_counts([text.encode("utf-8", "surrogatepass")])):
                    columns = [pa.array([name] * len(codes), pa.string()), pa.array(np.full(len(codes), k, np.int32)), pa.array(codes), pa.array(found)]
                    yield pa.RecordBatch.from_arrays(columns, names=["name", "k", "code", "n"])

    runs = sample.select("sample_lang", "sample_text").mapInArrow(count, "name string, k int, code long, n long")
    sums = runs.groupBy("name", "k", "code").agg(F.sum("n").alias("n")).toArrow()
    # a language whose sampled texts are all empty is learned too, from nothing
    names = [r["sample_lang"] for r in sample.select("sample_lang").distinct().collect()]
    if not names:
        return None
    name, k, code, n = (sums.column(c).to_numpy() for c in ("name", "k", "code", "n"))
    order = np.lexsort((code, k))
    name, k, code, n = name[order], k[order], code[order], n[order]
    return ContextTrees({own: [(code[at], n[at]) for order in range(ORDER + 1) for at in [(name == own) & (k == order)]] for own in names})


def predicted(trees: ContextTrees | None, texts: list[str | None], overlap: float) -> list[tuple[str, float]]:
    found = [(UNDETERMINED, 0.0)] * len(texts)
    lettered = [at for at, text in enumerate(texts) if trees is not None and text and any(map(str.isalpha, text))]
    if lettered:
        bits = trees.bits([texts[at].encode("utf-8", "surrogatepass") for at in lettered])
        for at, own in zip(lettered, bits):
            best = int(own.argmin())
            found[at] = trees.languages[best], float(1 / np.exp2(np.maximum((own[best] - own) / overlap, -1000)).sum())
    return found


def predict_language(
    docs: DataFrame, *, learn: Column, lang: Column | None = None, per_language: int = 400, overlap: float = 4.0
) -> DataFrame:
    """Predicted language of every whole text.

    The model learns from the rows where ``learn`` is true and ``lang`` is not null, at most ``per_language`` of each
    language (the documented bound of the sample); predicting uses the text alone. Returns ``doc_id``, ``lang_pred`` and
    ``score``: the probability of the predicted language given equal priors, with bits counted 1 / ``overlap``, because
    neighbouring contexts overlap and bytes are not independent evidence.

    Defined cases: ``und`` with score 0 for null, empty and letterless texts and where nothing could be learned; an equal
    code length goes to the first language by code point; other columns of ``docs`` are ignored, repeated rows predicted
    each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, learn, lang, per_language))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predicted(shared.value, batch.column(1).to_pylist(), overlap)
            arrays = [pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(predict, schema)


def keep_known(
    docs: DataFrame, *, learn: Column, least: float = 0.5, lang: Column | None = None, per_language: int = 400, overlap: float = 4.0
) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language is determined with a score of ``least`` or more; in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, learn, lang, per_language))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predicted(shared.value, batch.column(at).to_pylist(), overlap)
            yield batch.filter(pa.array([n != UNDETERMINED and s >= least for n, s in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
