"""URL filters: longest-match rules, and for the rest trust and distrust spread over the links between hosts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.llm.tables import written

_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host, its subdomains and the paths that begin like ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null and without ``://``."""
    return _lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, null if none does. Rules are a configured list, tried from the longest on."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(value(rule))) if found is None else found.when(fits, F.lit(value(rule)))
    return F.lit(None).cast("string") if found is None else found


def host_links(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """Links between different hosts: ``src``, ``dst``, ``pages`` (how many pages of ``src`` link to ``dst``).

    Each page counts once per target, and counts are combined on the map side, so a hot host is one row per task.
    """
    targets = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)), lambda h: _lower(h)))
    links = pages.select(host.alias("src"), F.explode(targets).alias("dst")).where((F.col("src") != F.col("dst")) & (F.col("src") != ""))
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pages"))


def propagate(
    seeds: DataFrame, links: DataFrame, *, damping: float = 0.85, rounds: int | None = 10, outweighs: float = 2.0, tolerance: float = 1e-9
) -> DataFrame:
    """Personalised PageRank of trust along the links and of distrust against them.

    It takes ``rounds`` rounds; with None they go on until no further one can change whether a host's distrust is more than
    ``outweighs`` times its trust: until no host is reached for the first time, and what all later rounds can move (it shrinks
    by ``damping`` each round) is less than the margin of every host that both have reached. Margins below ``tolerance`` of all
    seeds are not waited for. One row per round comes to the driver.

    ``seeds``: ``host``, ``trust_seed``, ``distrust_seed``. A host hands its trust on to the hosts it links to, by pages; and
    its distrust back to the hosts that link to it. Each round is one pass over the links, written to cut the lineage; links
    are one row per pair of hosts, so what a round shuffles is a rank per link. Without links the seeds stand.
    """
    both = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    nodes = seeds.join(both, "host", "full").select(
        "host", F.coalesce("trust_seed", F.lit(0.0)).alias("trust_seed"), F.coalesce("distrust_seed", F.lit(0.0)).alias("distrust_seed")
    )
    ranks = written(nodes.withColumns({"trust": F.col("trust_seed"), "distrust": F.col("distrust_seed")}), "host-ranks")
    if links.isEmpty():
        return ranks
    out = links.groupBy("src").agg(F.sum("pages").alias("out_pages"))
    into = links.groupBy("dst").agg(F.sum("pages").alias("in_pages"))
    weighted = links.join(out, "src").join(into, "dst").select(
        "src", "dst", (F.col("pages") / F.col("out_pages")).alias("ahead"), (F.col("pages") / F.col("in_pages")).alias("back")
    )
    weighted = written(weighted, "host-links")
    total = ranks.agg(F.sum("trust_seed") * outweighs + F.sum("distrust_seed")).first()[0] or 0.0
    done = 0
    while True:
        ahead = weighted.join(ranks.select(F.col("host").alias("src"), "trust"), "src").select(
            F.col("dst").alias("host"), (F.col("trust") * F.col("ahead")).alias("trust_in"), F.lit(0.0).alias("distrust_in")
        )
        back = weighted.join(ranks.select(F.col("host").alias("dst"), "distrust"), "dst").select(
            F.col("src").alias("host"), F.lit(0.0).alias("trust_in"), (F.col("distrust") * F.col("back")).alias("distrust_in")
        )
        heard = ahead.union(back).groupBy("host").agg(F.sum("trust_in").alias("trust_in"), F.sum("distrust_in").alias("distrust_in"))
        spread = ranks.join(heard, "host", "left")
        mixed = {
            n: (1 - damping) * F.col(f"{n}_seed") + damping * F.coalesce(F.col(f"{n}_in"), F.lit(0.0)) for n in ("trust", "distrust")
        }
        old = {f"old_{n}": F.col(n) for n in ("trust", "distrust")}
        stepped = written(
            spread.withColumns(old).withColumns(mixed).select("host", "trust_seed", "distrust_seed", "trust", "distrust", *old), "host-ranks"
        )
        moved = {n: F.abs(F.col(n) - F.col(f"old_{n}")) for n in ("trust", "distrust")}
        reached = [((F.col(n) > 0) & (F.col(f"old_{n}") == 0)) for n in ("trust", "distrust")]
        margin = F.when((F.col("trust") > 0) & (F.col("distrust") > 0), F.abs(F.col("distrust") - outweighs * F.col("trust")))
        state = stepped.agg(
            F.count_if(reached[0] | reached[1]).alias("reached"),
            (F.sum(moved["trust"]) * outweighs + F.sum(moved["distrust"])).alias("moved"),
            F.min(margin).alias("margin"),
        ).first()
        ranks = stepped.drop(*old)
        ahead_of_us = damping / (1 - damping) * state["moved"]
        done += 1
        if done == rounds:
            return ranks
        if rounds is None and not state["reached"] and (state["margin"] is None or ahead_of_us < state["margin"] or ahead_of_us <= tolerance * total):
            return ranks


def judge(
    pages: DataFrame, rules: Sequence[Rule], *, damping: float = 0.85, outweighs: float = 2.0
) -> DataFrame:
    """A verdict for every page: the longest rule's, else its host's.

    The pages that rules allow make their hosts trusted seeds, those that rules block make them distrusted ones, each by
    number of pages. A host is blocked if its distrust is more than ``outweighs`` times its trust, so a host about which
    nothing is known is allowed.

    ``pages`` has ``page_id``, ``url``, ``html``; other columns are ignored. Returns ``page_id``, ``host``, ``path``,
    ``rule``, ``verdict``. Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is
    allowed; null html has no links; repeated rows count each; an empty table gives none.
    """
    located = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    ruled = located.withColumns(
        {"rule": matched(rules, host, path, lambda r: r.text), "ruled": matched(rules, host, path, lambda r: r.verdict)}
    )
    seeds = (
        ruled.where("ruled is not null")
        .groupBy("host")
        .agg(
            F.count(F.when(F.col("ruled") == "allow", 1)).cast("double").alias("trust_seed"),
            F.count(F.when(F.col("ruled") == "block", 1)).cast("double").alias("distrust_seed"),
        )
    )
    links = written(host_links(pages, host_of(F.col("url")), F.col("html")), "host-pairs")
    ranks = propagate(seeds, links, damping=damping, rounds=None, outweighs=outweighs)
    blocked = written(ranks.where(F.col("distrust") > outweighs * F.col("trust")).select("host"), "hosts-blocked")
    marked = ruled.join(blocked.withColumn("distrusted", F.lit(True)), "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("distrusted"), "block").otherwise("allow"))
    return marked.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
