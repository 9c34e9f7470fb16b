import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tillweave.functions import dates, geo, values


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def day(text):
    return F.lit(dt.date.fromisoformat(text))


def test_week_difference_counts_sundays(spark):
    # Monday to the fourth Sunday: four boundaries although only three whole weeks have passed
    assert one(spark, dates.sunday_weeks_between(day("2025-04-27"), day("2025-03-31"))) == 4
    assert one(spark, dates.sunday_weeks_between(day("2025-04-26"), day("2025-03-31"))) == 3
    assert one(spark, dates.sunday_weeks_between(day("2025-04-06"), day("2025-04-06"))) == 0
    assert one(spark, dates.sunday_weeks_between(day("1969-12-27"), day("1970-01-04"))) == -2


@pytest.mark.parametrize(
    "given,sunday,monday,report",
    [
        ("2025-05-03", "2025-04-27", "2025-04-28", "2025-05-04"),  # Saturday
        ("2025-05-04", "2025-05-04", "2025-04-28", "2025-05-11"),  # Sunday
        ("2025-05-05", "2025-05-04", "2025-05-05", "2025-05-04"),  # Monday reports last week
        ("2025-05-06", "2025-05-04", "2025-05-05", "2025-05-11"),
    ],
)
def test_week_starts(spark, given, sunday, monday, report):
    assert one(spark, dates.sunday_week_start(day(given))) == dt.date.fromisoformat(sunday)
    assert one(spark, dates.monday_week_start(day(given))) == dt.date.fromisoformat(monday)
    assert one(spark, dates.reporting_week_end(day(given))) == dt.date.fromisoformat(report)


def test_local_date_follows_summer_time(spark):
    winter = F.to_timestamp(F.lit("2025-06-30 11:30:00"))
    summer = F.to_timestamp(F.lit("2025-01-31 11:30:00"))
    assert one(spark, dates.local_date(winter, "Pacific/Auckland")) == dt.date(2025, 6, 30)
    assert one(spark, dates.local_date(summer, "Pacific/Auckland")) == dt.date(2025, 2, 1)


def test_ascending_range_never_counts_down(spark):
    assert one(spark, dates.ascending_range(F.lit(2), F.lit(4))) == [2, 3, 4]
    assert one(spark, dates.ascending_range(F.lit(4), F.lit(2))) == []
    assert one(spark, dates.ascending_range(F.lit(4), F.lit(4))) == [4]


def test_rates_with_empty_spans_are_null(spark):
    assert one(spark, dates.per_month(F.lit(10), day("2025-01-01"), day("2025-01-01"))) is None
    assert one(spark, dates.per_month(F.lit(10), day("2025-01-01"), day("2025-01-31"))) == 10
    assert one(spark, values.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, values.relative_change(F.lit(3.0), F.lit(0.0))) is None
    assert one(spark, values.relative_change(F.lit(3.0), F.lit(2.0))) == 0.5


def test_blank_and_null_flags(spark):
    df = spark.createDataFrame([("",), ("a",), (None,)], "id string")
    assert [r.id for r in df.filter(values.is_present(F.col("id"))).collect()] == ["a"]
    assert [r[0] for r in df.select(values.blank_to_null(F.col("id"))).collect()] == [None, "a", None]
    flags = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [tuple(r) for r in flags.select(values.is_true(F.col("f")), values.is_false(F.col("f"))).collect()] == [
        (True, False), (False, True), (False, False),
    ]


def test_text_helpers(spark):
    assert [one(spark, values.two_digits(F.lit(n))) for n in (7, 12, 123)] == ["07", "12", "123"]
    assert one(spark, values.json_text(F.lit(None).cast("array<string>"))) == "null"
    assert one(spark, values.json_text(F.array(F.lit("a"), F.lit(None)))) == '["a",null]'
    assert one(spark, values.split_field(F.lit("a|b"), "|", 1)) == "b"
    with pytest.raises(PySparkException):
        one(spark, values.split_field(F.lit("a|b"), "|", 2))


def test_haversine(spark):
    auckland, wellington = (-36.8485, 174.7633), (-41.2866, 174.7756)
    km = one(spark, geo.haversine_km(*[F.lit(v) for v in (*auckland, *wellington)]))
    assert abs(km - 493.5) < 1
    assert one(spark, geo.haversine_km(*[F.lit(v) for v in (*auckland, *auckland)])) == 0
