"""Join of texts that differ by a few characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillweave.sources.staging import stage

_GRAM = 2


def _grams(text: Column) -> Column:
    """Pairs of neighbouring characters, ends marked, each with how often it came before: no two are equal."""
    marked = F.concat(F.lit("\x02"), text, F.lit("\x03"))
    grams = F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(marked, i, F.lit(_GRAM)))
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda h: h == g)).cast("string")))


def _shortened(text: Column, most: int) -> Column:
    """The text and what is left of it after up to ``most`` characters are taken out."""
    found = F.array(text)
    for _ in range(most):
        cut = F.transform(found, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1, F.length(t)))))
        found = F.array_distinct(F.concat(found, F.flatten(cut)))
    return found


def similar_pairs(left: DataFrame, right: DataFrame, *, most: int = 2) -> DataFrame:
    """All pairs of texts (``left_text``, ``right_text``, ``distance``) at edit distance ``most`` or less, equal ones included.

    Both frames have one column; each different text is looked at once, NULLs never. An edit changes at most two of a text's
    pairs of characters, so two near texts share one of the 2 * ``most`` + 1 pairs of each that are rarest overall: only these
    are joined on. Texts too short for that meet by what is left of them without up to ``most`` characters. The distance then
    decides; no near pair is lost.
    """
    first, second = (df.select(F.col(df.columns[0]).alias("text")).where("text is not null").distinct() for df in (left, right))
    texts = stage(first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1))), "similar-texts")
    prefix = _GRAM * most + 1
    # a text of n characters has n + 1 pairs; up to ``most`` more characters are in reach of a short one
    short = prefix - 2 + most
    grams = texts.withColumn("gram", F.explode(_grams(F.col("text"))))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    rank = Window.partitionBy("side", "text").orderBy("texts", "gram")
    rare = stage(grams.join(counts, "gram").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= prefix).select("side", "text", "gram"), "similar-grams")
    brief = texts.where(F.length("text") <= short).withColumn("gram", F.explode(_shortened(F.col("text"), most)))

    def meet(rows: DataFrame) -> DataFrame:
        a = rows.where("side = 0").select("gram", F.col("text").alias("left_text"))
        b = rows.where("side = 1").select("gram", F.col("text").alias("right_text"))
        return a.join(b, "gram").where(F.abs(F.length("left_text") - F.length("right_text")) <= most).select("left_text", "right_text")

    candidates = meet(rare).unionByName(meet(brief)).distinct()
    distance = F.levenshtein("left_text", "right_text", most)
    return candidates.withColumn("distance", distance).where("distance >= 0")
