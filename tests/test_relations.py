"""The general relation operators against brute force or Spark's own (slower) forms."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.test_scale import NO_BROADCAST, plan_of, settings
from tillweave.functions.clock import RunClock
from tillweave.operators import asof, frequent, intervals, ordered, refreshes, reshape, rollups, similar, summaries

D = dt.date


# ---- intervals ----


def overlapping(a, b):
    return None not in (*a, *b) and a[0] <= a[1] and b[0] <= b[1] and max(a[0], b[0]) <= min(a[1], b[1])


def random_spans(draw, n, reach):
    rows = []
    for i in range(n):
        begin = draw.randint(-reach, reach)
        length = draw.choice([0, 0, 1, 7, 8, 63, 64, draw.randint(0, reach), -1])
        span = draw.choice([(begin, begin + length)] * 9 + [(None, begin), (begin, None)])
        rows.append((i, draw.choice(["x", "x", "y", None]), *span))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_interval_join_equals_brute_force(spark, seed):
    draw = random.Random(seed)
    left, right = random_spans(draw, 120, 10 ** (seed + 2)), random_spans(draw, 90, 10 ** (seed + 2))
    a = spark.createDataFrame(left, "l int, k string, lb long, le long")
    b = spark.createDataFrame(right, "r int, k string, rb long, re long")
    options = dict(left_span=("lb", "le"), right_span=("rb", "re"))
    for on in (["k"], []):
        want = [(x[0], y[0]) for x in left for y in right if (not on or (x[1] == y[1] and x[1] is not None)) and overlapping(x[2:], y[2:])]
        other = b if on else b.withColumnRenamed("k", "other")
        met = [(r.l, r.r) for r in intervals.interval_join(a, other, on=on, **options).collect()]
        assert len(met) == len(want) and set(met) == set(want)
        kept = [(r.l, r.r) for r in intervals.interval_join(a, other, on=on, how="left", **options).collect()]
        alone = {x[0] for x in left} - {x for x, _ in want}
        assert len(kept) == len(want) + len(alone) and set(kept) == set(want) | {(x, None) for x in alone}


def test_interval_join_of_dates_times_points_and_open_ends(spark):
    offers = spark.createDataFrame([("a", D(2024, 12, 30), D(2025, 1, 2)), ("b", D(2025, 1, 1), None), ("c", None, None)], "offer string, first date, last date")
    days = spark.createDataFrame([(D(2024, 12, 29) + dt.timedelta(n),) for n in range(6)], "day date")
    met = intervals.interval_join(days, offers, left_span=("day", "day"), right_span=("first", "last"), open_ends=True)
    counts = Counter(r.offer for r in met.collect())
    assert counts == {"a": 4, "b": 3, "c": 6}
    t = dt.datetime(2025, 1, 1)
    sessions = spark.createDataFrame([(1, t, t + dt.timedelta(hours=1)), (2, t + dt.timedelta(microseconds=1), t + dt.timedelta(days=400))], "s int, b timestamp, e timestamp")
    clicks = spark.createDataFrame([(0, t), (1, t + dt.timedelta(hours=1)), (2, t + dt.timedelta(hours=1, microseconds=1)), (3, None)], "c int, at timestamp")
    met = intervals.interval_join(clicks, sessions, left_span=("at", "at"), right_span=("b", "e"))
    assert sorted((r.c, r.s) for r in met.collect()) == [(0, 1), (1, 1), (1, 2), (2, 2)]
    with pytest.raises(ValueError, match="both sides"):
        intervals.interval_join(days, days, left_span=("day", "day"), right_span=("day", "day"))


def test_interval_join_shuffles_the_same_for_long_spans(spark):
    """A year's windows and a century's: no nested loop, and each window is in two bins at most."""
    days = spark.range(1000).selectExpr("cast(id as int) as day")
    rows = []
    for length in (10, 300, 30_000):
        spans = spark.range(50).selectExpr("cast(id as int) as w", "cast(id * 20 as int) as b", f"cast(id * 20 + {length} as int) as e")
        with settings(spark, **NO_BROADCAST):
            met = intervals.interval_join(days, spans, left_span=("day", "day"), right_span=("b", "e"))
            assert met.count() == sum(b <= d <= b + length for b in range(0, 1000, 20) for d in range(1000))
            assert "NestedLoop" not in plan_of(met) and "Cartesian" not in plan_of(met)
        spanned = intervals._spanned(spans, ("b", "e"), "right", False)
        rows.append(intervals._binned(spanned, "right", intervals._levels(spanned, "right"), [0]).count())
    assert max(rows) <= 100


# ---- as-of ----


@pytest.mark.parametrize("partitions", [1, 7])
def test_asof_equals_brute_force(spark, partitions):
    """A hot key with two thirds of the rows goes over several partitions; ties, NULLs, keys of one side only."""
    draw = random.Random(partitions)
    keys = ["hot"] * 8 + ["a", "b", "only", None]
    left = [(i, draw.choice(keys), draw.choice([None, *range(60)])) for i in range(400)]
    right = [(draw.choice(keys[:-2] + [None, "other"]), draw.choice([None, *range(0, 60, 7)]), draw.choice([None, 1.0, 2.0, 3.0])) for _ in range(80)]
    a = spark.createDataFrame(left, "i int, k string, t int")
    b = spark.createDataFrame(right, "k string, since int, price double")
    with settings(spark, **NO_BROADCAST, spark__sql__shuffle__partitions=partitions, spark__sql__adaptive__coalescePartitions__enabled="false"):
        got = asof.asof_join(a, b, on=["k"], left_time="t", right_time="since", values=["price"])
        assert got.columns == ["i", "k", "t", "since", "price"]
        rows = {r.i: (r.since, r.price) for r in got.collect()}
    assert len(rows) == len(left)
    for i, key, time in left:
        fits = [(s, p is not None, p) for k, s, p in right if key is not None and k == key and None not in (s, time) and s <= time]
        assert rows[i] == ((max(fits)[0], max(fits)[2]) if fits else (None, None)), i


def test_asof_spreads_a_hot_key(spark):
    left = spark.range(20_000).selectExpr("'hot' as k", "id as t")
    right = spark.range(0, 20_000, 5000).selectExpr("'hot' as k", "id as since", "id * 10 as price")
    with settings(spark, spark__sql__shuffle__partitions=8, spark__sql__adaptive__coalescePartitions__enabled="false"):
        rows = ordered.ranged(left, ["k", "t"])
        assert rows.groupBy("part").count().agg(F.max("count")).first()[0] < 6000
        got = asof.asof_join(left, right, on=["k"], left_time="t", right_time="since", values=["price"])
        assert got.where("price != floor(t / 5000) * 50000 or price is null").isEmpty() and got.count() == 20_000


@pytest.mark.parametrize("partitions", [1, 8])
def test_asof_reads_each_side_once_and_shuffles_them_once(spark, tmp_path, monkeypatch, partitions):
    """Also rows without a key or time come from the staged rows; a hot key's spans, rows of the key's type and time are kept."""

    def written(df, name):
        path = f"file://{tmp_path}/{name}-{partitions}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    monkeypatch.setattr(asof, "stage", written)
    left = spark.range(1000).selectExpr("id as i", "if(id % 10 = 0, null, 'k' || id % 300) as k", "if(id % 7 = 0, null, int(id)) as t")
    right = spark.range(0, 1000, 3).selectExpr("'k' || id % 300 as k", "id as since", "id * 10 as price")
    with settings(spark, spark__sql__shuffle__partitions=partitions):
        got = asof.asof_join(left, right, on=["k"], left_time="t", right_time="since", values=["price"])
        plan = plan_of(got)
        assert plan.count("Exchange hashpartitioning") == 1 and "Range (" not in plan
        rows = {r.i: r for r in got.collect()}
    assert got.schema["t"].dataType == left.schema["t"].dataType and len(rows) == 1000
    for i, r in rows.items():
        fits = [s for s in range(0, 1000, 3) if s % 300 == i % 300 and s <= i]
        whole = i % 10 and i % 7
        assert (r.k, r.t) == (f"k{i % 300}" if i % 10 else None, i if i % 7 else None)
        assert r.price == (max(fits) * 10 if whole and fits else None)


def test_asof_cuts_hot_keys_only(spark):
    rows = spark.range(4000).selectExpr("if(id % 2 = 0, 'hot', 'k' || id) as k", "int(id) as asof_time")
    with settings(spark, spark__sql__shuffle__partitions=8):
        cuts = {r.k: r.asof_cuts for r in asof._spans(rows, ["k"]).collect()}
        assert list(cuts) == ["hot"] and len(cuts["hot"]) >= 8 and cuts["hot"] == sorted(set(cuts["hot"]))
        assert asof._spans(rows.where("k <> 'hot'"), ["k"]) is None


# ---- ordered windows ----


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_ordered_equals_plain_windows(spark, partitions):
    """Also with partitions shorter than the frames."""
    draw = random.Random(5)
    rows = [(i, draw.choice([None, draw.randint(0, 1000)]), draw.randint(0, 20)) for i in range(97)]
    df = spark.createDataFrame(rows, "i int, x int, g int")
    order = ["g", "i"]
    reach = lambda w: {"p": F.lag("x", 3).over(w), "n": F.lead("x", 2).over(w), "s": F.sum("x").over(w.rowsBetween(-10, 2)), "f": F.first("x").over(w.rowsBetween(-1, 0))}
    with settings(spark, **NO_BROADCAST, spark__sql__shuffle__partitions=partitions, spark__sql__adaptive__coalescePartitions__enabled="false"):
        got = ordered.windowed(ordered.numbered(df, order, running={"total": "x"}), order, reach, before=10, after=2)
        assert "SinglePartition" not in plan_of(got)
        found = sorted(tuple(r) for r in got.collect())
    w = Window.orderBy(*order)
    plain = df.withColumns({"number": F.row_number().over(w), "total": F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    want = sorted(tuple(r) for r in plain.withColumns(reach(Window.orderBy(*order))).collect())
    assert [(r[0], r[3:]) for r in found] == [(r[0], r[3:]) for r in want]


def test_ordered_empty(spark):
    empty = spark.createDataFrame([], "i int, x int")
    assert ordered.numbered(empty, ["i"], running={"total": "x"}).count() == 0
    assert ordered.windowed(empty, ["i"], lambda w: {"p": F.lag("x").over(w)}, before=1).count() == 0


# ---- totals ----


def test_grouping_sets_equal_the_built_in(spark):
    draw = random.Random(9)
    rows = [(draw.choice(["a", "b", None]), draw.choice(["x", None]), draw.choice([1, 2, 3]), draw.choice([None, 1.5, 2.5])) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string, c int, v double")
    measures = {"total": ("sum", "v"), "n": ("count", "v"), "low": ("min", "v"), "high": ("max", "v")}
    as_rows = lambda frame: Counter(tuple(r) for r in frame.select("a", "b", "c", "grouping_id", *measures).collect())
    df.createOrReplaceTempView("grouping_rows")
    text = "select a, b, c, grouping_id(a, b, c) as grouping_id, sum(v) as total, count(v) as n, min(v) as low, max(v) as high from grouping_rows group by "
    assert as_rows(rollups.rollup(df, ["a", "b", "c"], measures)) == as_rows(spark.sql(text + "rollup (a, b, c)"))
    assert as_rows(rollups.cube(df, ["a", "b", "c"], measures)) == as_rows(spark.sql(text + "cube (a, b, c)"))
    some = rollups.grouping_sets(df, ["a", "b", "c"], [["c"], ["a", "c"], ["b"]], measures)
    assert as_rows(some) == as_rows(spark.sql(text + "a, b, c grouping sets ((a, c), (c), (b))"))
    assert "Expand" not in plan_of(some)
    nothing = rollups.rollup(df.where("false"), ["a"], measures).collect()
    assert [(r.a, r.grouping_id, r.n, r.total) for r in nothing] == [(None, 1, 0, None)]


# ---- most frequent value ----


def test_frequent_values_lie_within_their_bounds(spark):
    """Far more different values than a summary holds, in very uneven groups, merged from weekly parts."""
    draw = random.Random(3)
    rows = []
    for group, (n, common) in enumerate([(20_000, 0.3), (20_000, 0.02), (3000, 0.004), (50, 0.5), (7, 0.0)]):
        for _ in range(n):
            value = 7.25 if draw.random() < common else draw.choice([None, *range(5000)])
            rows.append((group, draw.randint(1, 8), None if value is None else float(value)))
    df = spark.createDataFrame(rows, "g int, week int, x double").repartition(6)
    items = 64
    weekly = frequent.value_summaries(df, ["g", "week"], "x", items=items)
    found = {r.g: r for r in frequent.most_frequent(frequent.merged_summaries(weekly, ["g"], items=items), ["g"], items=items).collect()}
    for group, r in found.items():
        counts = Counter(x for g, _, x in rows if g == group)
        top = max(counts.values())
        assert r.rows == sum(counts.values()) and r.at_least <= top <= r.at_most
        assert r.value is None or r.at_least <= counts[r.value]
        modes = [x for x, n in counts.items() if n == top]
        assert all(r.maybe_null if x is None else r.low <= x <= r.high for x in modes)
        assert not r.certain or modes == [r.value]
    assert found[0].certain and found[0].value == 7.25 and found[4].at_least == found[4].at_most == 1 and found[3].certain and not found[2].certain


# ---- sketches ----


def test_summaries_keep_their_errors(spark):
    rows = spark.range(200_000).selectExpr("id % 2 as g", "id % 8 as week", "cast(id * 7919 % 40009 as string) as who", "cast(id * 104729 % 200000 as double) as amount")
    weekly = summaries.period_states(rows, ["g", "week"], distinct="who", value="amount")
    for keys in (["g"], ["g", "week"]):
        found = summaries.estimates(summaries.merged_states(weekly, keys), keys, quantiles=(0.1, 0.5, 0.9))
        exact = rows.groupBy(*keys).agg(F.countDistinct("who").alias("true"), *[F.percentile("amount", F.lit(q)).alias(f"t{round(100 * q)}") for q in (0.1, 0.5, 0.9)])
        for r in found.join(exact, keys).collect():
            assert abs(r.distinct_estimate - r.true) <= 4 * summaries.distinct_error() * r.true
            # amounts are spread evenly over 200,000, so an error of ranks is one of amounts
            assert all(abs(r[f"q{q}"] - r[f"t{q}"]) <= 2 * summaries.rank_error() * 200_000 for q in (10, 50, 90))


# ---- refreshes ----


def test_refreshes_equal_the_set_operators(spark):
    draw = random.Random(2)
    make = lambda: [(draw.choice(["a", "b", None]), draw.choice([1, 2, None])) for _ in range(40)]
    old, new = (spark.createDataFrame(make(), "a string, b int") for _ in range(2))
    count = lambda df: Counter(tuple(r) for r in df.collect())
    assert count(refreshes.except_all(old, new)) == count(old.exceptAll(new)) == count(old) - count(new)
    assert count(refreshes.intersect_all(old, new)) == count(old.intersectAll(new)) == count(old) & count(new)
    changes = refreshes.refresh_changes(old, new).collect()
    assert {(r.a, r.b): (r.removed, r.added) for r in changes} == {
        k: (max(0, count(old)[k] - count(new)[k]), max(0, count(new)[k] - count(old)[k])) for k in set(count(old)) | set(count(new)) if count(old)[k] != count(new)[k]
    }
    assert refreshes.refresh_changes(old, old).isEmpty()


# ---- week pivot and back ----


def test_unpivot_gives_the_facts_back(spark):
    facts = spark.createDataFrame([("a", "202501", 1.0), ("a", "202503", 2.0), ("b.c", "202501", None), ("b.c", "202502", 4.0)], "article_id string, week string, sales double")
    wide = facts.groupBy("article_id").pivot("week").agg(F.sum("sales"))
    long = reshape.unpivot_weeks(wide, keys=["article_id"])
    assert Counter(tuple(r) for r in long.collect()) == Counter(tuple(r) for r in facts.dropna().collect())
    assert reshape.unpivot_weeks(wide, keys=["article_id"], keep_empty=True).count() == 6
    with pytest.raises(TypeError, match="name"):
        reshape.unpivot_weeks(wide.withColumn("name", F.lit("x")), keys=["article_id"])


# ---- similar texts ----


def slow_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        line = [i]
        for j, y in enumerate(b, 1):
            line.append(min(last[j] + 1, line[-1] + 1, last[j - 1] + (x != y)))
        last = line
    return last[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_similar_pairs_equal_brute_force(spark, most):
    draw = random.Random(most)
    word = lambda: "".join(draw.choice("abé ") for _ in range(draw.choice([0, 1, 2, 3, 4, 5, 6, 9, 14])))
    left, right = {word() for _ in range(150)}, {word() for _ in range(150)}
    frame = lambda words: spark.createDataFrame([(w,) for w in [*words, *list(words)[:5], None]], "t string")
    got = [tuple(r) for r in similar.similar_pairs(frame(left), frame(right), most=most).collect()]
    want = {(a, b, slow_distance(a, b)) for a in left for b in right if slow_distance(a, b) <= most}
    assert len(got) == len(want) and set(got) == want


# ---- the instant of a run ----


def test_run_clock_is_one_instant(spark):
    clock = RunClock(dt.datetime(2025, 6, 30, 15, 30, tzinfo=dt.timezone.utc), "Asia/Tokyo")
    assert clock.today == D(2025, 7, 1) and clock.week_start == D(2025, 6, 30) and clock.weeks_back(1) == D(2025, 6, 24)
    frame = spark.range(3).select(clock.stamp().alias("at"))
    for zone in ("UTC", "America/New_York"):
        with settings(spark, spark__sql__session__timeZone=zone):
            assert {r.at for r in frame.collect()} == {dt.datetime(2025, 7, 1, 0, 30)}
    with pytest.raises(ValueError):
        RunClock(dt.datetime(2025, 1, 1), "UTC")
    with pytest.raises(Exception, match="Nowhere"):
        RunClock.now("Nowhere/At_All")


def test_nothing_else_asks_for_the_time():
    from pathlib import Path

    package = Path(reshape.__file__).parent.parent
    for path in package.rglob("*.py"):
        if path.name != "clock.py" and "llm" not in path.parts:
            text = path.read_text()
            assert not any(word in text for word in ("current_timestamp", "current_date", ".now(", ".today()", "curdate", "localtimestamp")), path
