"""Assigning articles to campaign brands by rules given as data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.functions.values import contains_any

DISPUTED = "DISPUTED"


@dataclass(frozen=True)
class Clause:
    """One way to belong to a brand: any of the positive tests holds and none of the negative ones.

    Text tests look for upper-case fragments in the article name or its source brand; ``brand_is`` is an exact match.
    A NULL name or brand satisfies neither a positive nor a negative test.
    """

    name_has: Sequence[str] = ()
    brand_has: Sequence[str] = ()
    brand_is: Sequence[str] = ()
    name_lacks: Sequence[str] = ()
    brand_lacks: Sequence[str] = ()

    def condition(self, name: Column, brand: Column) -> Column:
        positive = []
        if self.name_has:
            positive.append(contains_any(name, self.name_has))
        if self.brand_has:
            positive.append(contains_any(brand, self.brand_has))
        if self.brand_is:
            positive.append(F.upper(brand).isin([b.upper() for b in self.brand_is]))
        tests = [reduce(or_, positive, F.lit(False))]
        if self.name_lacks:
            tests.append(~contains_any(name, self.name_lacks))
        if self.brand_lacks:
            tests.append(~contains_any(brand, self.brand_lacks))
        return reduce(and_, tests)


@dataclass(frozen=True)
class BrandRule:
    """A brand, the clauses that lead to it, and article ids that are always in, always out, or in dispute.

    ``allow_ids`` bypass the clauses and ``deny_ids``; ``disputed_ids`` are labelled ``DISPUTED`` instead of the brand.
    """

    brand: str
    clauses: Sequence[Clause] = field(default_factory=tuple)
    allow_ids: Sequence[str] = ()
    deny_ids: Sequence[str] = ()
    disputed_ids: Sequence[str] = ()

    def label(self) -> Column:
        article, name, brand = F.col("article_id"), F.col("article_name"), F.col("online_brand")
        matched = reduce(or_, [c.condition(name, brand) for c in self.clauses], F.lit(False))
        if self.deny_ids:
            matched = matched & ~article.isin(list(self.deny_ids))
        if self.allow_ids:
            matched = matched | article.isin(list(self.allow_ids))
        outcome = F.lit(self.brand)
        if self.disputed_ids:
            outcome = F.when(article.isin(list(self.disputed_ids)), DISPUTED).otherwise(outcome)
        return F.when(matched, outcome)


def brand_rule_classifier(articles: DataFrame, rules: Sequence[BrandRule], ranged: DataFrame) -> DataFrame:
    """Articles with every brand that claims them, for articles that were ranged at least once.

    One pass over the articles evaluates all rules; an article may get several brands.
    """
    labels = F.array_compact(F.array(*[rule.label() for rule in rules]))
    ever_ranged = ranged.select("article_id").distinct()
    return (
        articles.join(ever_ranged, "article_id", "left_semi")
        .select("article_id", F.explode(labels).alias("brand"), "article_name")
        .distinct()
    )


def duplicate_brand_check(classified: DataFrame) -> DataFrame:
    """Articles that more than one brand claims."""
    return classified.groupBy("article_id").agg(F.count("brand").alias("brands")).filter(F.col("brands") > 1)
