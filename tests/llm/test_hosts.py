from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillweave.llm import hosts, queries

PAGES = [
    (1, "http://Good.example.ORG/a", '<a href="https://friend.example.net/x">f</a> <a href="/own">o</a>'),
    (2, "https://friend.example.net/p?x=1", "<a HREF='//pal.example.net/y'>p</a>"),
    (3, "https://shop.example.com/de/1", '<a href="http://farm.example.net/">s</a>'),
    (4, "https://farm.example.net/1", '<a href=https://shop.example.com/de/9>x</a> <a href="https://shop.example.com/fr/">y</a>'),
    (5, "https://farm2.example.net/1#t", '<a href="https://farm.example.net/1"></a>'),
    (6, "no scheme", None),
    (7, None, "<a href='http://x.example/'>"),
    (8, "https://example.org/es/tail", ""),
    (9, "https://a.example.org/en/12", ""),
    (10, "https://org", ""),
    (11, "https://pal.example.net", ""),
    (11, "https://pal.example.net", ""),
    (12, "ftp://x.example.com/fr/://y/z", ""),
]
SCHEMA = "page_id long, url string, html string"


def slow_ranks(seeds, pages_linking, rounds=10):
    out, into = Counter(), Counter()
    for (a, b), n in pages_linking.items():
        out[a] += n
        into[b] += n
    rank = {h: list(s) for h, s in seeds.items()}
    for _ in range(rounds):
        new = {h: [0.15 * s[0], 0.15 * s[1]] for h, s in seeds.items()}
        for (a, b), n in pages_linking.items():
            new[b][0] += 0.85 * rank[a][0] * n / out[a]
            new[a][1] += 0.85 * rank[b][1] * n / into[b]
        rank = new
    return rank


def test_ranks_equal_brute_force(spark):
    links = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 3, ("c", "a"): 1, ("d", "c"): 5}
    seeds = {"a": (1.0, 0.0), "b": (0.0, 0.0), "c": (0.0, 2.0), "d": (0.0, 0.0), "e": (3.0, 1.0)}
    found = hosts.propagate(
        spark.createDataFrame([(h, *s) for h, s in seeds.items() if any(s)], "host string, trust_seed double, distrust_seed double"),
        spark.createDataFrame([(*k, n) for k, n in links.items()], "src string, dst string, pages long"),
    )
    wanted = slow_ranks(seeds, links)
    got = {r["host"]: [r["trust"], r["distrust"]] for r in found.collect()}
    assert set(got) == set(wanted)
    for host in wanted:
        assert got[host] == pytest.approx(wanted[host])


def test_verdicts(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA).withColumn("host", F.lit("clash")).withColumn("trust", F.lit(1))
    rows = hosts.judge(pages, queries.RULES).collect()
    assert len(rows) == len(PAGES)
    found = defaultdict(list)
    for r in rows:
        found[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert found[1] == [("good.example.org", "/a", "org/", "allow")]
    assert found[3] == [("shop.example.com", "/de/1", "com/de/", "block")]
    assert found[4][0][2:] == (None, "block")  # links to a blocked host
    assert found[5][0][2:] == (None, "block")  # links to one that does
    assert found[2][0] == ("friend.example.net", "/p", None, "allow")
    assert found[6] == [("", "", None, "allow")] and found[7] == [("", "", None, "allow")]
    assert found[8][0][2:] == ("example.org/es/", "block")
    assert found[9][0][2:] == ("example.org/en/1", "block")
    assert found[10][0] == ("org", "", None, "allow")
    assert len(found[11]) == 2
    assert found[12][0] == ("x.example.com", "/fr/://y/z", "com/fr/", "allow")


def test_links_count_pages(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    links = hosts.host_links(pages, hosts.host_of(F.col("url")), F.col("html"))
    got = {(r["src"], r["dst"]): r["pages"] for r in links.collect()}
    assert got == {
        ("good.example.org", "friend.example.net"): 1,
        ("friend.example.net", "pal.example.net"): 1,
        ("shop.example.com", "farm.example.net"): 1,
        ("farm.example.net", "shop.example.com"): 1,
        ("farm2.example.net", "farm.example.net"): 1,
    }


def test_main_path_has_no_python(spark):
    plan = queries.op9_hosts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark):
    assert hosts.judge(spark.createDataFrame([], SCHEMA), queries.RULES).count() == 0


def test_chain_behind_a_blocked_host_is_blocked_throughout(spark):
    """Fifteen hosts, each linking to the next, the last to a blocked one; and fifteen that a trusted host leads to."""
    link = lambda host: f'<a href="https://{host}/x">'
    rows = [(0, "https://bad.example.com/de/1", "")]
    rows += [(i, f"https://h{i}.example.net/", link(f"h{i - 1}.example.net" if i > 1 else "bad.example.com")) for i in range(1, 16)]
    rows += [(100, "https://good.example.org/", link("g1.example.net"))]
    rows += [(100 + i, f"https://g{i}.example.net/", link(f"g{i + 1}.example.net")) for i in range(1, 16)]
    found = {r["page_id"]: r["verdict"] for r in hosts.judge(spark.createDataFrame(rows, SCHEMA), queries.RULES).collect()}
    assert all(found[i] == "block" for i in range(16)) and all(found[100 + i] == "allow" for i in range(16))


def test_ranks_settle_verdicts(spark):
    """Against many rounds of plain arithmetic, on a graph with cycles where trust and distrust meet."""
    import random

    draw = random.Random(4)
    names = [f"n{i}" for i in range(12)]
    links = {(a, b): draw.randint(1, 3) for a in names for b in draw.sample(names, 2) if a != b}
    seeds = {n: (float(draw.randint(0, 3)), float(draw.randint(0, 4))) for n in names[:6]}
    trust, distrust = ({n: seeds.get(n, (0, 0))[k] for n in names} for k in (0, 1))
    out, into = ({n: sum(w for e, w in links.items() if e[k] == n) for n in names} for k in (0, 1))
    for _ in range(300):
        trust, distrust = (
            {n: 0.15 * seeds.get(n, (0, 0))[0] + 0.85 * sum(trust[a] * w / out[a] for (a, b), w in links.items() if b == n) for n in names},
            {n: 0.15 * seeds.get(n, (0, 0))[1] + 0.85 * sum(distrust[b] * w / into[b] for (a, b), w in links.items() if a == n) for n in names},
        )
    frame = spark.createDataFrame([(n, *s) for n, s in seeds.items()], "host string, trust_seed double, distrust_seed double")
    edges = spark.createDataFrame([(*e, w) for e, w in links.items()], "src string, dst string, pages long")
    got = {r["host"]: r["distrust"] > 2 * r["trust"] for r in hosts.propagate(frame, edges, rounds=None).collect()}
    assert got == {n: distrust[n] > 2 * trust[n] for n in names if n in got} and len(got) >= 10
