"""Robots files by hand, and polite crawls: stopped and resumed, by rules, in time."""

from collections import Counter, defaultdict

import pytest

from quern.sources import robots
from quern.sources.crawl import Visits, crawl_politely

FILE = """# a comment alone ends a group
User-Agent: One
User-agent: two   # with a comment
Disallow: /private/
allow : /private/open
Crawl-delay: 2.5
Crawl-delay: soon
no colon here

Disallow: /nobody
Sitemap: https://a.example/map.xml
User-agent: *
Disallow: /*.pdf$
Disallow:
User-agent: three
Allow: /x
"""


def test_directives(spark):
    files = spark.createDataFrame([("a", FILE), ("b", None), ("c", "")], "site string, content string")
    got = [tuple(r) for r in robots.directives(files).orderBy("line", "agent").collect()]
    assert got == [
        ("a", 4, "one", "disallow", "/private/"), ("a", 4, "two", "disallow", "/private/"), ("a", 5, "one", "allow", "/private/open"), ("a", 5, "two", "allow", "/private/open"),
        ("a", 6, "one", "crawl-delay", "2.5"), ("a", 6, "two", "crawl-delay", "2.5"), ("a", 11, None, "sitemap", "https://a.example/map.xml"),
        ("a", 13, "*", "disallow", "/*.pdf$"), ("a", 14, "*", "disallow", ""), ("a", 16, "*", "allow", "/x"), ("a", 16, "three", "allow", "/x"),
    ]
    robots.register(spark)
    files.createOrReplaceTempView("robots_files")
    assert spark.sql("SELECT d.* FROM robots_files, LATERAL robots_directives(content) d").count() == len(got)


@pytest.mark.parametrize("bot, path, ok, delay", [
    ("ONE", "/private/x", False, 2.5), ("one", "/private/open/x", True, 2.5), ("two", "/private", True, 2.5), ("four", "/a.pdf", False, None),
    ("four", "/a.pdf.html", False, None), ("four", "/x/1", True, None), ("three", "/a.pdf", True, None),
])
def test_rules(spark, bot, path, ok, delay):
    rules = robots.rules_of(robots.directives(spark.createDataFrame([("a.example", FILE)], "site string, content string")), bot)
    urls = spark.createDataFrame([(f"https://a.example{path}?q#f",), ("http://none.example",)], "url string")
    got = {r["url"]: (r["allowed"], r["delay"]) for r in robots.judged(urls, rules).collect()}
    assert got == {f"https://a.example{path}?q#f": (ok, delay), "http://none.example": (True, None)}


def site(n, links):
    return "".join(f'<a href="{x}">x</a>' for x in links), n


@pytest.fixture(scope="module")
def web(spark):
    pages = []
    for s in ("a", "b"):
        pages.append((f"http://{s}.example/", site(0, [f"/{i}" for i in range(8)] + ["/no/1", "/gone", "http://b.example/7", "http://far.example/"])[0]))
        for i in range(8):
            pages.append((f"http://{s}.example/{i}", site(1, [f"/{i}/{j}" for j in range(3)] + ["/", "/no/2"])[0]))
            pages += [(f"http://{s}.example/{i}/{j}", site(2, [f"/{i}/{j}/deep"])[0]) for j in range(3)]
        pages += [(f"http://{s}.example/no/{k}", "<p>secret</p>") for k in (1, 2)]
    files = [("a.example", "User-agent: *\nDisallow: /no/\nCrawl-delay: 3"), ("b.example", "User-agent: *\nDisallow: /no/\nCrawl-delay: 0.01")]
    seeds = [("http://a.example/",), ("http://b.example/#top",), ("ftp://c.example/",)]
    frame = spark.createDataFrame
    return frame(pages, "url string, html string").repartition(3), robots.rules_of(robots.directives(frame(files, "site string, content string")), "quern"), frame(seeds, "url string")


def rows(df):
    return sorted(tuple(r) for r in df.select("url", "depth", "site", "status", "start_ms").collect())


def test_crawl_by_rules_and_in_time(web, tmp_path):
    pages, rules, seeds = web
    got = rows(crawl_politely(pages, rules, seeds, str(tmp_path / "one"), max_depth=2))
    status = Counter(r[3] for r in got)
    assert status == {"fetched": 2 * (1 + 8 + 24), "missing": 2, "disallowed": 4} and len({r[0] for r in got}) == len(got)
    assert all(r[3] == "disallowed" for r in got if "/no/" in r[0]) and not any("far." in r[0] for r in got)
    starts = defaultdict(list)
    for _, _, s, state, t in got:
        if state in ("fetched", "missing"):
            starts[s].append(t)
    for s, least in (("a.example", 3000), ("b.example", 100)):
        times = sorted(starts[s])
        assert len(times) == 34 and all(y - x >= least for x, y in zip(times, times[1:], strict=False))
    # Nearer pages are fetched first.
    for s in starts:
        by_depth = [(t, d) for _, d, x, _, t in got if x == s and t is not None]
        assert [d for _, d in sorted(by_depth)] == sorted(d for _, d in by_depth)


def test_crawl_goes_on_from_where_it_stopped(spark, web, tmp_path):
    pages, rules, seeds = web
    whole = rows(crawl_politely(pages, rules, seeds, str(tmp_path / "whole"), max_depth=3))
    part = rows(crawl_politely(pages, rules, seeds, str(tmp_path / "parts"), max_depth=3, rounds=1))
    assert {r[1] for r in part} == {0}
    # A round that broke off leaves files without its mark; they are written again.
    state = Visits(spark, str(tmp_path / "parts"))
    spark.createDataFrame([("http://a.example/broken", 1, "a.example", "fetched", 5)], "url string, depth int, site string, status string, start_ms long").write.parquet(f"{state.folder}/visited/round=1")
    assert {r[1] for r in rows(crawl_politely(pages, rules, seeds, state.folder, max_depth=3, rounds=1))} == {0, 1}
    assert rows(crawl_politely(pages, rules, seeds, state.folder, max_depth=3)) == whole
    assert rows(crawl_politely(pages, rules, seeds, state.folder, max_depth=3)) == whole


def test_crawl_limits(web, tmp_path):
    pages, rules, seeds = web
    got = rows(crawl_politely(pages, rules, seeds, str(tmp_path / "few"), max_depth=3, max_pages=5))
    assert Counter(r[3] for r in got)["fetched"] == 5 and max(r[1] for r in got if r[3] == "fetched") == 1
    assert rows(crawl_politely(pages, rules, seeds.limit(0), str(tmp_path / "none"))) == []
