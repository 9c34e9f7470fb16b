import functools
import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillweave.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=list("ab#|\n \té\xa0\x0b\x1c"), max_size=80))
def test_counts(text):
    assert quality.base_counts(text) == slow_counts(text)


def bucket(value):
    return -(10**9) if value <= 0 else math.floor(math.log(value) / math.log(quality.GAMMA))


def lent(own, coarse, weight=200):
    """Counts in units of a group, with those of its coarser group added as so many documents."""
    total = sum(coarse.values())
    return Counter(own) + Counter({b: math.floor(weight * (1 << 16) * (n / total)) for b, n in coarse.items()})


def quantile(units, q):
    """The upper edge of the bucket that holds the unit of that rank."""
    rank, upto = math.ceil(sum(units.values()) * q), 0
    for b in sorted(units):
        upto += units[b]
        if upto >= rank:
            return 0.0 if b == -(10**9) else quality.GAMMA ** (b + 1)


def test_query_equals_brute_force(spark, documents):
    source = {r["doc_id"]: r for r in documents.collect()}
    counts = {i: slow_counts(r["text"]) for i, r in source.items()}
    measured = {}
    for i, (words, chars, symbols, repeats_lines, repeats) in counts.items():
        lines = max(1, sum(1 for line in (source[i]["text"] or "").split("\n") if WORD.search(line)))
        n = max(1, words)
        measured[i] = {"word_length": chars / n, "symbols": symbols / n, "dup_lines": repeats_lines / lines, "repeats": repeats / n}

    def units(name, rows):
        return Counter({b: n << 16 for b, n in Counter(bucket(measured[i][name]) for i in rows).items()})

    @functools.cache
    def limit(lang, origin, name):
        everyone = units(name, source)
        of_lang = lent(units(name, [i for i, r in source.items() if r["lang"] == lang]), everyone)
        group = lent(units(name, [i for i, r in source.items() if (r["lang"], r["source"]) == (lang, origin)]), of_lang)
        low, high = quantile(group, 0.25), quantile(group, 0.75)
        times, least = quality.RULES[name]
        spread = max(high - low, least)
        return low - times * spread, high + times * spread

    for r in queries.op8_quality(spark, "/root/testdata/sf0.001").collect():
        i = r["doc_id"]
        assert tuple(r[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts[i]
        failed = counts[i][0] < 50 or 100 * counts[i][4] > 50 * counts[i][0]
        within = all(low <= v <= high for n, v in measured[i].items() for low, high in [limit(source[i]["lang"], source[i]["source"], n)])
        assert r["base_failed"] == failed and r["kept"] == (not failed and within)


def test_groups_have_limits_of_their_own(spark):
    docs = spark.range(1200).select(
        F.col("id").alias("doc_id"),
        F.lit("en").alias("lang"),
        F.when(F.col("id") % 2 == 0, "code").otherwise("prose").alias("source"),
        F.concat(
            F.repeat(F.concat(F.lit("word"), F.col("id"), F.lit(" ")), 1),
            F.array_join(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.concat(F.lit("w"), i * 7919 + F.col("id"))), " "),
            F.when((F.col("id") % 2 == 0) | (F.col("id") == 11), F.repeat(F.lit("#"), 70)).otherwise(""),
        ).alias("text"),
    )
    dropped = {r["doc_id"] for r in quality.quality(docs).where("not kept").collect()}
    assert dropped == {11}  # as many symbols as code has, in prose


def test_limits_do_not_jump_with_a_group_s_size(spark):
    """One more document moves a limit by a bucket or two at most, whatever the group's size."""

    def most(rows):
        counted = spark.range(2000 + rows).select(
            F.col("id").alias("doc_id"),
            F.lit("en").alias("lang"),
            F.when(F.col("id") < 2000, "prose").otherwise("code").alias("source"),
            *[F.lit(n).cast("long").alias(c) for c, n in (("n_words", 100), ("n_dup_lines", 0), ("n_repeat_words", 0), ("n_lines", 1))],
            F.when(F.col("id") < 2000, 400 + F.col("id") % 200).otherwise(900 + F.col("id") % 200).alias("word_chars"),
            F.lit(0).cast("long").alias("n_symbols"),
        )
        return {r["source"]: r["word_length_most"] for r in quality.thresholds(counted).collect()}["code"]

    sizes = [most(n) for n in (1, 199, 200, 201, 20_000)]
    assert sizes[1] == sizes[2] == sizes[3]
    assert sizes[0] < sizes[-1]  # alone it follows the language, in numbers its own values
    assert sizes[-1] < 20


def test_odd_rows(odd, empty):
    rows = quality.quality(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (3, 4, 5):
            assert r["n_words"] == r["word_chars"] == 0 and r["base_failed"] and not r["kept"]
    assert quality.quality(empty).count() == 0
