"""Quality rules with thresholds that adapt to each language and source, from mergeable quantile sketches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.llm.tables import written

_SYMBOLS = b"#*$%&|<>"
_BLANK = " \t\n\v\f\r"
_STAT_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Relative error of a sketch's quantiles: bucket i holds values from GAMMA ** i to GAMMA ** (i + 1).
GAMMA = 1.05


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, and words inside 3-word windows that occur twice or more."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(text.count(c) for c in _BLANK)
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.split()] if b"\n" in raw else []
    repeated = 0
    if len(words) > 3:
        numbers: dict[bytes, int] = {}
        code = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        _, pairs = np.unique(code[:-1] * len(numbers) + code[1:], return_inverse=True)  # exact: numbers of pairs, then of triples
        _, triples, often = np.unique(pairs[:-1] * len(numbers) + code[2:], return_inverse=True, return_counts=True)
        at = np.flatnonzero(often[triples] > 1)
        covered = np.zeros(len(words), bool)
        for i in range(3):
            covered[at + i] = True
        repeated = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def with_base_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the five counts of every whole text, and the number of lines with a word."""
    names = (*_STAT_NAMES, "n_lines")
    schema = T.StructType([docs.schema["doc_id"], docs.schema["lang"], docs.schema["source"]] + [T.StructField(n, T.LongType()) for n in names])
    line = re.compile(r"[^\x20\x09-\x0D]")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(3).to_pylist():
                lines = sum(1 for part in (text or "").split("\n") if line.search(part))
                rows.append((*base_counts(text), lines))
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays(batch.columns[:3] + [pa.array(c, pa.int64()) for c in columns], names=schema.fieldNames())

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(count, schema)


def measures() -> dict[str, Column]:
    """What the adaptive rules look at, all free of a text's length."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
    }


def sketches(counted: DataFrame, groups: list[str]) -> DataFrame:
    """Quantile sketches: per group and measure, how many values fall into each logarithmic bucket (``bucket`` null: zero).

    Sketches merge by adding counts, so partial ones are combined before the shuffle, a hot group is no more work than any
    other, and the result does not depend on the order. A sketch has some hundred buckets whatever the number of values.
    """
    value = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), c.alias("value")) for n, c in measures().items()]))
    rows = counted.select(*groups, value.alias("m")).select(*groups, "m.measure", "m.value")
    bucket = F.when(F.col("value") > 0, F.floor(F.log(F.col("value")) / F.log(F.lit(GAMMA))).cast("int"))
    return rows.groupBy(*groups, "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, groups: list[str], at: dict[str, float]) -> DataFrame:
    """Quantiles of each group and measure: the upper edge of the bucket in which the quantile's rank falls."""
    of = Window.partitionBy(*groups, "measure")
    up = of.orderBy(F.col("bucket").asc_nulls_first())
    ranked = sketch.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(of))
    edge = F.coalesce(F.pow(F.lit(GAMMA), F.col("bucket") + 1), F.lit(0.0))
    picked = [F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), edge)).alias(name) for name, q in at.items()]
    return ranked.groupBy(*groups, "measure").agg(F.max("total").alias("total"), *picked)


#: measure -> (how many spreads above the upper quantile a value may lie, least spread). Spread: upper minus lower quantile.
RULES = {"word_length": (3.0, 1.0), "symbols": (3.0, 0.1), "dup_lines": (3.0, 0.2), "repeats": (3.0, 0.1)}


#: Counts of blended sketches are whole numbers of this fraction of a document, so that their sums are exact.
_UNIT = 1 << 16


def blended(fine: DataFrame, coarse: DataFrame, groups: list[str], shared: list[str], weight: int) -> DataFrame:
    """Sketches of ``groups``, each with the sketch of the coarser group it belongs to added as ``weight`` documents.

    ``fine`` and ``coarse`` hold counts in units; ``shared`` are the columns that name the coarser group. A small group
    follows the coarser one, a large one its own values, and nothing switches in between.
    """
    total = coarse.groupBy(*shared, "measure").agg(F.sum("n").alias("total"))
    c, t = coarse.alias("c"), total.alias("t")
    same = F.col("c.measure") == F.col("t.measure")
    for name in shared:
        same = same & F.col(f"c.{name}").eqNullSafe(F.col(f"t.{name}"))
    share = F.floor(F.lit(weight * _UNIT) * (F.col("c.n") / F.col("t.total"))).cast("long")
    prior = c.join(t, same).select(*[F.col(f"c.{n}").alias(n) for n in shared], "c.measure", "c.bucket", share.alias("n"))
    g, p = fine.select(*groups, "measure").distinct().alias("g"), prior.alias("p")
    member = F.col("g.measure") == F.col("p.measure")
    for name in shared:
        member = member & F.col(f"g.{name}").eqNullSafe(F.col(f"p.{name}"))
    lent = g.join(p, member).select(*[F.col(f"g.{n}").alias(n) for n in groups], "g.measure", "p.bucket", "p.n")
    return fine.unionByName(lent).groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))


def thresholds(counted: DataFrame, *, prior_rows: int = 200, rules: dict[str, tuple[float, float]] = RULES) -> DataFrame:
    """Upper and lower limits of every measure for each language and source: one row each.

    A limit lies a number of spreads beyond the quartiles of the group's sketch. To that sketch its language's is added with
    the weight of ``prior_rows`` documents, and to the language's that of all documents in the same way; the coarser
    sketches are the sums of the groups' sketches.
    """
    edges = {"low": 0.25, "high": 0.75}
    fine = written(sketches(counted, ["lang", "source"]).withColumn("n", F.col("n") * _UNIT), "quality-sketches")
    by_lang = fine.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    overall = fine.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    of_lang = written(blended(by_lang, overall, ["lang"], [], prior_rows), "quality-languages")
    limits = quantiles(blended(fine, of_lang, ["lang", "source"], ["lang"], prior_rows), ["lang", "source"], edges)
    picked = []
    for name, (times, least) in rules.items():
        spread = F.greatest(F.col("high") - F.col("low"), F.lit(least))
        here = F.col("measure") == name
        picked += [
            F.max(F.when(here, F.col("high") + times * spread)).alias(f"{name}_most"),
            F.max(F.when(here, F.col("low") - times * spread)).alias(f"{name}_least"),
        ]
    return written(limits.groupBy("lang", "source").agg(*picked), "quality-limits")


def quality(docs: DataFrame, *, least_words: int = 50, most_repeats: int = 50, **options) -> DataFrame:
    """Base counts, the fixed base rules, and a verdict by limits that adapt to each language and source.

    Returns ``doc_id``, the counts, ``base_failed`` (fewer than ``least_words`` words, or over ``most_repeats`` in a hundred
    of them in repeated 3-word windows), one limit pair per measure, ``kept`` (false if a base rule fails, else whether every
    measure lies within its limits). Limits come from all documents' counts and are joined back by language and source.

    Defined cases: null, empty and blank texts have zero counts and fail; a null language or source is a group of its own;
    a group whose values are all alike has the least spread around them; repeated rows count each; other columns are
    ignored; an empty table gives none.
    """
    counted = written(with_base_counts(docs), "quality-counts")
    limits = thresholds(counted, **options)
    d, t = counted.alias("d"), limits.alias("t")
    joined = d.join(t, F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source")))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    within = F.lit(True)
    for name, value in measures().items():
        within = within & (value <= F.col(f"{name}_most")) & (value >= F.col(f"{name}_least"))
    return joined.select(
        "doc_id", *_STAT_NAMES, failed.alias("base_failed"), (~failed & within).alias("kept"), *[f"{n}_most" for n in measures()]
    )
