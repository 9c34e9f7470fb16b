"""Token counts by a map-side two-tier lookup: a broadcast table of frequent pre-tokens, then a cache in each worker."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.llm.encoding import Generations

# No piece of the vocabulary has a space mark behind another character, and none a newline; so a text falls apart before
# every space that follows something else, and before every newline. `independent` checks this for the model at hand.
_RUNS = re.compile(r" *[^ \n]+| +|\n")
_MARK = "▁"


@functools.lru_cache(maxsize=2)
def library(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def independent(path: str) -> bool:
    """Whether texts of this model may be counted by pre-token."""
    model = library(path)
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
    apart = all(_MARK not in p.lstrip(_MARK) and "\n" not in p and " " not in p for p in pieces)
    # a leading space is added, spaces are kept, and nothing is normalised away
    plain = model.encode("a  b") == model.encode("a ") + model.encode("b") or model.encode("\ta  b", out_type=str)[0] == _MARK
    return apart and plain and model.encode("\n", out_type=str) == [_MARK, "<0x0A>"]


def pre_tokens(text: str) -> list[str]:
    """Parts of a text, with the leading space the model adds, whose token counts add up to the text's.

    A space mark written out in a text is the same to the model as a space.
    """
    return _RUNS.findall(" " + text.replace(_MARK, " "))


def part_length(path: str, part: str) -> int:
    """Tokens of one part: the library adds a leading space of its own, which a part with a space lends it."""
    if part.startswith(" "):
        return len(library(path).encode(part[1:], num_threads=1)) if len(part) > 1 else 1
    if part == "\n":
        return 1
    # behind a newline: the added space mark would merge with the word, so a newline is put between
    return len(library(path).encode("\n" + part, num_threads=1)) - 2


def frequent_parts(docs: DataFrame, path: str, *, entries: int = 20_000, sample_rows: int = 1_000, per_task: int = 5_000) -> dict[str, int]:
    """The tier that is broadcast: lengths of parts that are frequent in a random sample of documents, ``entries`` at most.

    About ``sample_rows`` documents are drawn whatever the size of the table. Each task counts the parts of those it holds
    and hands its ``per_task`` most frequent ones to the driver, so parts are never shuffled. What is not in the table is
    encoded where it occurs: the sample changes speed only, never a count.
    """
    rows = docs.count()
    if not rows:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    found.update(pre_tokens(text))
                if len(found) > 20 * per_task:
                    found = Counter(dict(found.most_common(10 * per_task)))
        top = found.most_common(per_task)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["part", "n"]
        )

    drawn = docs.select("text").sample(fraction=min(1.0, sample_rows / rows), seed=1)
    counted = drawn.mapInArrow(count, "part string, n long").toArrow().group_by("part").aggregate([("n", "sum")])
    top = counted.sort_by([("n_sum", "descending"), ("part", "ascending")]).slice(0, entries)
    return {part: part_length(path, part) for part in top["part"].to_pylist()}


_caches: dict[tuple[str, int], Generations] = {}


def _cache(path: str, limit: int) -> Generations:
    """The second tier, kept for as long as the Python worker lives."""
    if (path, limit) not in _caches:
        _caches[path, limit] = Generations(functools.partial(part_length, path), limit)
    return _caches[path, limit]


def token_counts(docs: DataFrame, path: str, *, limit: int = 4096, entries: int = 20_000, sample_rows: int = 1_000, cache: int = 200_000) -> DataFrame:
    """Tokens of every whole text as the sentencepiece model at ``path`` gives them, without begin and end tokens.

    Returns ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens). Null and empty texts count 0;
    other columns of ``docs`` are ignored, repeated rows are counted each. A model whose pieces cross words is not split:
    its texts are encoded whole. ``entries`` and ``sample_rows`` bound the table of frequent parts and the documents it is
    taken from, ``cache`` the entries a worker keeps; they change speed only.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    split = independent(path)
    table = docs.sparkSession.sparkContext.broadcast(frequent_parts(docs, path, entries=entries, sample_rows=sample_rows) if split else {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rare = table.value, _cache(path, cache)
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                sizes.append(len(text.encode()))
                if not split:
                    tokens.append(len(library(path).encode(text, num_threads=1)) if text else 0)
                    continue
                known = [frequent.get(p) or rare[p] for p in pre_tokens(text)] if text else []
                tokens.append(sum(known))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=schema.fieldNames()
            )

    return docs.select("doc_id", "text").mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
