"""Mix sources to target weights: random keys, a range sort within each source, prefix sums, one exact cut per source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillweave.llm.tables import id_text, partitions, word_count, written


def target_table(sources: DataFrame, *, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, cap: int = 3) -> DataFrame:
    """Add ``weight`` and ``target`` to one row per source (``source``, ``source_size``).

    Sources by code point, null last, take the weights in turn. ``share`` of all sizes is dealt out by weight; a target
    stops at ``cap`` times its source's size and what is over is dealt to the others by weight, until none is above: with
    sources ordered by cap per weight, the level of the rest is the largest (left over) / (weight left over) on the way.
    The table has a row per source, so its windows need no partitioning.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    order = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("rank", F.row_number().over(turn)).withColumn(
        "weight", F.element_at(order, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("ceiling", F.col("source_size").cast("double") * cap)
    by_ratio = Window.orderBy((F.col("ceiling") / F.col("weight")).asc(), "rank")
    everything = Window.partitionBy()
    ahead = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("ceiling").over(ahead), F.lit(0.0))
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        ranked.withColumn("level", left / weight_left)
        .withColumn("target", F.least("ceiling", F.max("level").over(everything) * F.col("weight")))
        .drop("level", "ceiling", "rank")
    )


def _keyed(docs: DataFrame, size: Column, source: Column, seed: str) -> DataFrame:
    key = F.md5(F.concat(F.lit(seed), id_text(F.col("doc_id"))).cast("binary"))
    return docs.select("doc_id", source.cast("string").alias("source"), size.cast("long").alias("size"), key.alias("mix_key"))


def mix_plan(
    docs: DataFrame,
    *,
    size: Column | None = None,
    source: Column | None = None,
    weights: Sequence[float] = (1, 2, 3),
    share: float = 1.0,
    cap: int = 3,
    seed: str = "mix",
) -> tuple[DataFrame, DataFrame]:
    """The keyed documents and the cut of each source: whole epochs, and how far the last, partial one goes.

    Documents are range-sorted by (source, random key, id, size) over all partitions, so that a hot source spreads over
    many; sizes are summed per partition and source first, and only the one partition that holds a source's cut is ranked
    row by row. Cuts come back as one row per source.
    """
    spark = docs.sparkSession
    size = word_count(F.col("text")) if size is None else size
    keyed = written(_keyed(docs, size, F.col("source") if source is None else source, seed), "mix-keyed")
    order = [F.col("source").asc_nulls_last(), F.col("mix_key"), F.col("doc_id"), F.col("size")]
    ranged = written(
        keyed.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "mix-ranged"
    )
    parts = written(ranged.groupBy("part", "source").agg(F.sum("size").alias("part_size")), "mix-parts")
    sources = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    targets = target_table(sources, weights=weights, share=share, cap=cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = written(
        targets.withColumn("epochs", whole).withColumn(
            "rest", F.floor("target") - F.col("epochs") * F.col("source_size")
        ),
        "mix-targets",
    )
    # A source has at most one row per partition here.
    so_far = Window.partitionBy("p.source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("part_size").over(so_far), F.lit(0))
    at = (
        parts.alias("p")
        .join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
        .select(F.col("p.part"), F.col("p.source").alias("at_source"), "part_size", "rest", before.alias("before"))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("part_size")))
    )
    at = written(at, "mix-at")
    rows = ranged.join(at.withColumnRenamed("part", "at_part"), F.col("part") == F.col("at_part")).where(
        F.col("source").eqNullSafe(F.col("at_source"))
    )
    peers = Window.partitionBy("part", "source").orderBy("mix_key", "doc_id", "size")
    alike = Window.partitionBy("part", "source", "mix_key", "doc_id", "size")
    ends = F.col("before") + F.sum("size").over(peers.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cut = (
        rows.withColumn("ends", ends)
        .withColumn("alike", F.count(F.lit(1)).over(alike))
        .withColumn("left", F.col("rest") - (F.col("ends") - F.col("alike") * F.col("size")))
        .where((F.col("left") >= 0) & (F.col("rest") < F.col("ends")))
        # equal rows share what is left evenly
        .select(
            F.col("source").alias("cut_source"),
            F.struct("mix_key", "doc_id", "size").alias("cut_at"),
            F.floor(F.col("left") / F.col("alike")).cast("long").alias("cut_take"),
        )
        .distinct()
    )
    cuts = targets.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    return keyed, written(cuts, "mix-cuts")


def mix(docs: DataFrame, **options) -> DataFrame:
    """How many words a mix takes of every document.

    ``docs`` needs ``doc_id``, ``source`` and ``text`` (or a ``size`` column expression); other columns are ignored.
    Returns ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``epochs``, ``taken``, ``whole_copies``. A
    source's ``taken`` adds up to its target rounded down: whole epochs, then its documents in random order until the
    budget is used up, the last one in part. ``whole_copies`` is the same decision in whole documents (the last one goes in
    if at least half of it is taken). The random order is a hash of the id, so reruns agree.

    Defined cases: null or empty text has size 0 and is never taken for words; a null source is a source of its own, last
    in order; rows alike in id, source and size share the last part of a budget evenly; an empty table gives none.
    """
    keyed, cuts = mix_plan(docs, **options)
    joined = keyed.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
    here = F.struct(F.col("d.mix_key"), F.col("d.doc_id"), F.col("d.size"))
    partial = (
        F.when(F.col("c.cut_at").isNull(), F.lit(0))
        .when(here < F.col("c.cut_at"), F.col("d.size"))
        .when(here == F.col("c.cut_at"), F.col("c.cut_take"))
        .otherwise(F.lit(0))
    )
    extra = F.when(here < F.col("c.cut_at"), 1).when((here == F.col("c.cut_at")) & (2 * F.col("c.cut_take") >= F.col("d.size")), 1)
    return joined.select(
        F.col("d.doc_id"),
        F.col("d.source"),
        F.col("d.size"),
        F.col("c.source_size").cast("long").alias("source_size"),
        F.col("c.target"),
        F.col("c.epochs"),
        (F.col("c.epochs") * F.col("d.size") + partial).cast("long").alias("taken"),
        (F.col("c.epochs") + F.coalesce(extra, F.lit(0))).cast("int").alias("whole_copies"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in whole documents: every row of ``docs`` as often as the mix takes it, columns unchanged.

    The decision needs only the row and its source's cut (one row per source), so no text is shuffled.
    """
    size = word_count(F.col("text")) if options.get("size") is None else options["size"]
    source = F.col("source") if options.get("source") is None else options["source"]
    _, cuts = mix_plan(docs, **options)
    key = F.md5(F.concat(F.lit(options.get("seed", "mix")), id_text(F.col("doc_id"))).cast("binary"))
    # the row goes along as one struct, so that its columns' names meet no others
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.struct(key.alias("mix_key"), F.col("doc_id"), size.cast("long").alias("size")).alias("here"),
        source.cast("string").alias("of_source"),
    )
    extra = F.when(F.col("here") < F.col("cut_at"), 1).when(
        (F.col("here") == F.col("cut_at")) & (2 * F.col("cut_take") >= F.col("here.size")), 1
    )
    copies = (F.col("epochs") + F.coalesce(extra, F.lit(0))).cast("int")
    return (
        rows.join(cuts.select("source", "epochs", "cut_at", "cut_take"), F.col("of_source").eqNullSafe(F.col("source")))
        .select("row", copies.alias("copies"))
        .where("copies > 0")
        .select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
        .select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    )
