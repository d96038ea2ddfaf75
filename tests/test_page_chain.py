"""Pages followed by their links: long chains, cycles, cuts, orphans, repeats."""

import json
import random

from pyspark.sql import types as T

from dealscreen.sources.page_chain import page_chain

RECORD = T.StructType([T.StructField("k", T.LongType())])
BASE = "https://h/api"


def follow(bodies, start):
    """The records, in order, that a client reads."""
    out, seen, url = [], set(), start
    while url and url not in seen and url in bodies:
        seen.add(url)
        try:
            body = json.loads(bodies[url])
        except ValueError:
            break
        out += [r["k"] for r in body.get("value", [])]
        url = body.get("@odata.nextLink") or ""
        url = url if "://" in url or not url else f"{BASE}/{url.lstrip('/')}"
    return out


def chain(spark, rows, starts):
    pages = spark.createDataFrame(rows, "feed string, url string, body string, day int").repartition(3)
    c = page_chain(pages, spark.createDataFrame(starts, "feed string, url string"), RECORD, BASE, newest=["day"])
    got = {}
    for r in sorted(c.records.collect(), key=lambda r: (r.feed, r.at, r.nth)):
        got.setdefault(r.feed, []).append(r.k)
    return got, sorted(((r.feed, r.kind, r.url, r.at) for r in c.breaks.where("feed IS NOT NULL").collect()), key=str), c


def test_random_chains(spark):
    """Random links over many pages: as a client that goes page by page."""
    rng, rows, bodies = random.Random(1), [], {}
    for feed in "abcd":
        n, texts = 60, {}
        for i in range(n):
            link = rng.choice([f"p{i + 1}"] * 30 + [f"p{rng.randrange(n)}", "", None, f"{BASE}/p{i + 2}", "p999"])
            texts[f"{BASE}/p{i}"] = json.dumps({"value": [{"k": 100 * i + j} for j in range(3)], "@odata.nextLink": link} if link is not None
                                              else {"value": [{"k": 100 * i}]})
        bodies[feed] = texts
        rows += [(feed, u if rng.random() < 0.5 else u.removeprefix(BASE + "/"), t, 1) for u, t in texts.items()]
    got, _, _ = chain(spark, rows, [(f, "p0") for f in "abcd"])
    assert got == {f: follow(bodies[f], f"{BASE}/p0") for f in "abcd"}


def test_breaks(spark):
    page = lambda k, link: json.dumps({"value": [{"k": k}], "@odata.nextLink": link})
    rows = [("cut", "p0", page(0, "p1"), 1), ("cut", "p1", page(1, "p2")[:-5], 1), ("cut", "p2", page(2, None), 1),
            ("cycle", "p0", page(0, "p1"), 1), ("cycle", "p1", page(1, "p2"), 1), ("cycle", "p2", page(2, "p1"), 1),
            ("gone", "p0", page(0, "p7"), 1), ("gone", "p8", page(8, ""), 1), ("self", "p0", page(0, "p0"), 1),
            ("twice", "p0", page(0, "p1"), 1), ("twice", "p0", page(5, "p1"), 2), ("twice", "p1", json.dumps({"x": 1}), 1),
            ("null", None, page(1, None), 1), (None, "p0", page(1, None), 1), ("empty", "p0", None, 1)]
    got, breaks, c = chain(spark, rows, [(f, "/p0") for f in ("cut", "cycle", "gone", "self", "twice", "no", "empty")])
    assert got == {"cut": [0], "cycle": [0, 1, 2], "gone": [0], "self": [0], "twice": [5]}
    assert set(breaks) == {
        ("cut", "unparsed", f"{BASE}/p1", 1), ("cut", "orphan", f"{BASE}/p2", None), ("cycle", "cycle", f"{BASE}/p2", 2),
        ("gone", "missing", f"{BASE}/p7", 1), ("gone", "orphan", f"{BASE}/p8", None), ("self", "cycle", f"{BASE}/p0", 0),
        ("twice", "repeated", f"{BASE}/p0", 0), ("no", "missing", f"{BASE}/p0", 0), ("null", "orphan", None, None),
        ("empty", "unparsed", f"{BASE}/p0", 0)} and len(breaks) == 10
    assert c.unparsed.count() == 2


def test_nothing(spark):
    got, breaks, _ = chain(spark, [], [])
    assert got == {} and breaks == []
