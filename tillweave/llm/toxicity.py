"""Toxicity by compression distance: how much a dictionary of toxic text shortens each window of a text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.llm.tables import hash_sample, written

LEVEL, WINDOW = 12, 8  # compression level; words of a window
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 4_096
_ROUNDS = 2  # how often the ordinary dictionary is extended by what it was found to lack
_LOW, _HIGH = -3, 10  # differences beyond are counted there


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def windows(of: list[bytes]) -> Iterator[bytes]:
    """Runs of ``WINDOW`` words that cover a text without gaps."""
    for low in range(0, len(of), WINDOW):
        yield b" " + b" ".join(of[low : low + WINDOW]) + b" "


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; with too few samples to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False
    )


@dataclass
class Model:
    """Two dictionaries, the weight of each difference in window length, and the calibrated threshold and slope."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    threshold: float = 0.0
    slope: float = 1.0

    def scorer(self):
        plain, aware = compressor(self.ordinary), compressor(self.toxic + self.ordinary)

        def gain(window: bytes) -> int:
            return len(plain.compress(window)) - len(aware.compress(window))

        def histogram(text: str | None) -> np.ndarray:
            found = np.zeros(_HIGH - _LOW + 1)
            for window in windows(words(text)):
                found[min(max(gain(window), _LOW), _HIGH) - _LOW] += 1
            return found

        histogram.gain = gain
        return histogram


def train(toxic: list[str], ordinary: list[str], prior: float) -> Model:
    """Fit on texts of both labels.

    The ordinary dictionary is trained on windows of ordinary texts. The toxic one is trained on what toxic texts have of
    their own: runs of the words that at least four of them hold, eight times as often as ordinary texts do. It is put
    before the ordinary content, so a window that holds nothing of it is compressed alike by both. Ordinary windows that it
    shortens all the same, as those of a rare language may be, go into a further ordinary dictionary. Three quarters of the
    texts make the dictionaries; on the last quarter the weight of a difference is its log-likelihood ratio between toxic
    and ordinary windows, and the threshold is where precision and recall of documents, at the labels' own ``prior``,
    balance best (F1, to within a hundredth).
    """
    held = slice(0, None, 4) if min(len(toxic), len(ordinary)) >= 40 else slice(0, None)
    rest = [[t for i, t in enumerate(x) if i % 4 or held.step is None] for x in (toxic, ordinary)]
    in_toxic, in_ordinary = (Counter(w for t in x for w in set(words(t))) for x in rest)
    least = 4 if len(rest[0]) >= 40 else 2
    own = {
        w
        for w, n in in_toxic.items()
        if n >= least and n / len(rest[0]) >= 8 * (in_ordinary[w] + 0.5) / max(1, len(rest[1]))
    }
    runs = [b" " + b" ".join(found) + b" " for t in rest[0] if (found := [w for w in words(t) if w in own])]
    runs *= max(1, -(-800 // max(1, len(runs))))
    plain = [w for t in rest[1] for w in windows(words(t))]
    plain = plain[:: max(1, len(plain) // 120_000)]
    model = Model(dictionary(plain, ORDINARY_BYTES), dictionary(runs, TOXIC_BYTES), np.zeros(_HIGH - _LOW + 1))
    for _ in range(_ROUNDS):  # ordinary windows that the toxic dictionary shortens belong into the ordinary one
        gain = model.scorer().gain
        mistaken = [w for w in plain if gain(w) > 0]
        if len(mistaken) < 50:
            break
        model.ordinary = dictionary(mistaken, ORDINARY_BYTES // 2) + model.ordinary
    histogram = model.scorer()
    hot, cold = (np.array([histogram(t) for t in x[held]]).reshape(-1, len(model.weights)) for x in (toxic, ordinary))
    telling = np.ones(len(hot), bool)  # toxic texts none of whose windows differs would blur the weights
    for _ in range(3):
        a, b = hot[telling].sum(axis=0) + 1, cold.sum(axis=0) + 1
        model.weights = np.log(a / a.sum()) - np.log(b / b.sum())
        telling = hot @ model.weights > 0
    up, down = np.sort(hot @ model.weights), np.sort(cold @ model.weights)
    cuts = np.unique(np.concatenate([up, down]))
    caught = prior * (1 - np.searchsorted(up, cuts) / max(1, len(up)))
    wrong = (1 - prior) * (1 - np.searchsorted(down, cuts) / max(1, len(down)))
    f1 = 2 * caught / np.maximum(caught + wrong + prior, 1e-12)
    at = int(np.argmax(f1 >= 0.99 * f1.max()))  # the lowest cut as good as the best: rather one more than one missed
    below = cuts[at - 1] if at else cuts[at] - 1
    model.threshold = float((cuts[at] + below) / 2)
    model.slope = 1 / max(0.25, float(np.std(down)))
    return model


def learned(docs: DataFrame, labels: DataFrame, learn: Column, toxic_rows: int, ordinary_rows: int) -> Model | None:
    """A model from the texts of at most so many labelled rows of each kind, chosen by a hash of the id; None without both."""
    known = labels.where("toxic is not null and doc_id is not null").where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = written(known, "toxic-known")
    bound = F.when(F.col("toxic") == 1, toxic_rows).otherwise(ordinary_rows)
    chosen = written(hash_sample(known, "toxic", "doc_id", bound), "toxic-sample")
    rows = (
        docs.select("doc_id", "text")
        .where("text is not null")
        .join(chosen, "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .orderBy("doc_id")
        .collect()
    )
    share = known.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0))).first()[0]
    toxic, ordinary = ([r["text"] for r in rows if (r["toxic"] == 1) == wanted] for wanted in (True, False))
    return train(toxic, ordinary, share) if toxic and ordinary else None


def scored(model: Model | None, histogram, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    sums = np.array([float(histogram(t) @ model.weights) for t in texts])
    return 1 / (1 + np.exp(np.clip((model.threshold - sums) * model.slope, -700, 700)))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, learn: Column, toxic_rows: int = 2_000, ordinary_rows: int = 4_000
) -> DataFrame:
    """Toxicity of every whole text: ``doc_id``, ``score`` (0 to 1, 0.5 at the calibrated threshold), ``predicted`` (0 or 1).

    ``labels`` has ``doc_id`` and ``toxic``; where ``learn`` (over ``doc_id``) is true they may be learned from, at most
    ``toxic_rows`` and ``ordinary_rows`` whole texts: that is all that comes to the driver. Scoring takes the text alone:
    the weights of its windows' differences are added up.

    Defined cases: a null, empty or blank text has no window and scores as such a sum of 0; without texts of both labels all
    score 0; rows that repeat an id are scored each; a document with several labels counts as toxic if one says so; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, learn, toxic_rows, ordinary_rows))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram = shared.value.scorer() if shared.value else None
        for batch in batches:
            scores = scored(shared.value, histogram, batch.column(1).to_pylist())
            marks = pa.array((scores >= 0.5).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), marks], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(score, schema)


def keep_ordinary(
    docs: DataFrame, labels: DataFrame, *, learn: Column, toxic_rows: int = 2_000, ordinary_rows: int = 4_000
) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text is not predicted toxic; in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, learn, toxic_rows, ordinary_rows))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram = shared.value.scorer() if shared.value else None
        for batch in batches:
            yield batch.filter(pa.array(scored(shared.value, histogram, batch.column(at).to_pylist()) < 0.5, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
