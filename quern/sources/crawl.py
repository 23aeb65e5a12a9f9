"""A breadth-first crawl over a page store: frontier, link extraction, visited set, in rounds of joins."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.html import page_links
from quern.functions.web import domain, normalise_url, skipped
from quern.operators.corpus import ranks
from quern.plans.lineage import cut
from quern.sources.files import write_small
from quern.sources.robots import judged


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int = 10_000, excluded: list[str] | None = None) -> DataFrame:
    """url, depth and domain of the pages reached from seeds(url) within their domains, nearest first, max_pages at most."""
    store = pages.select(normalise_url(F.col("url")).alias("url"), "html").filter("url is not null").dropDuplicates(["url"])
    frontier = cut(seeds.select(normalise_url(F.col("url")).alias("url")).filter("url is not null").distinct().select("url", F.lit(0).alias("depth")))
    allowed = cut(frontier.select(domain(F.col("url")).alias("d")).distinct())
    visited = frontier.limit(0)
    for depth in range(max_depth + 1):
        reached = cut(frontier.join(store, "url"))
        visited = cut(visited.union(reached.select("url", "depth")))
        if depth == max_depth or reached.isEmpty() or visited.count() >= max_pages:
            break
        links = reached.select(F.explode(page_links("html", "url")).alias("url")).select(normalise_url(F.col("url")).alias("url")).filter("url is not null").distinct()
        links = links.filter(~skipped(F.col("url"), excluded or [])).withColumn("d", domain(F.col("url"))).join(allowed, "d", "left_semi")
        frontier = cut(links.join(visited, "url", "left_anti").select("url", F.lit(depth + 1).alias("depth")))
    return visited.orderBy("depth", "url").limit(max_pages).withColumn("domain", domain(F.col("url")))


class Visits:
    """A crawl's state in a folder of any file system that Spark knows: the addresses of each round with what became of them,
    the next round's frontier, and each site's next allowed time. A round counts once its mark is written, which comes last,
    so a crawl that broke off repeats that round alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, part: str, number: int) -> str:
        return f"{self.folder}/{part}/round={number}"

    def last(self) -> int:
        """The last round that is complete; -1 if there is none."""
        try:
            return self.spark.read.text(f"{self.folder}/done").agg(F.max(F.col("value").cast("int"))).first()[0]
        except AnalysisException:
            return -1

    def put(self, part: str, number: int, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._path(part, number))
        return self.get(part, number)

    def get(self, part: str, number: int) -> DataFrame:
        return self.spark.read.parquet(self._path(part, number))

    def close(self, number: int) -> None:
        write_small(self.spark, f"{self.folder}/done/{number:06d}", str(number))

    def visited(self, number: int) -> DataFrame:
        """The addresses of all rounds up to this one."""
        return self.spark.read.parquet(*[self._path("visited", i) for i in range(number + 1)])


def crawl_politely(pages: DataFrame, rules: DataFrame, seeds: DataFrame, folder: str, max_depth: int = 3, max_pages: int = 10_000, bot: str = "quern", delay_ms: int = 1_000, excluded: list[str] | None = None, rounds: int | None = None) -> DataFrame:
    """url, depth, site, status (fetched, missing, disallowed, limit) and start_ms of the addresses met from seeds(url), within
    their sites; rules are those of ``robots.rules_of``.

    A round takes one depth's addresses. Those that the robots rules allow get start times by site, each at least the site's
    delay (its own, else delay_ms) after the one before, over rounds, too; places within a site come from a global sort, so
    a site of any size makes no task of its own. With rounds, it ends after so many; with the same folder it goes on from
    the last complete round. max_pages bounds the fetched pages, in order of depth and address.
    """
    spark, state = pages.sparkSession, Visits(pages.sparkSession, folder)
    store = pages.select(normalise_url(F.col("url")).alias("url"), "html").filter("url is not null").dropDuplicates(["url"])
    number = state.last() + 1
    if number == 0:
        first = seeds.select(normalise_url(F.col("url")).alias("url")).filter("url is not null").distinct()
        state.put("frontier", 0, first)
        state.put("sites", 0, first.select(domain(F.col("url")).alias("site")).distinct().withColumn("next_ms", F.lit(0).cast("long")))
    done = 0
    while number <= max_depth and (rounds is None or done < rounds):
        frontier, sites = state.get("frontier", number), state.get("sites", number)
        before = state.visited(number - 1) if number else None
        fetched = before.filter("status = 'fetched'").count() if number else 0
        fresh = frontier if before is None else frontier.join(before.select("url"), "url", "left_anti")
        within = judged(fresh.filter(~skipped(F.col("url"), excluded or [])), rules).join(sites.select("site"), "site", "left_semi")
        met = within.join(store.select("url", F.lit(True).alias("found")), "url", "left")
        placed = ranks(met.filter("allowed").select("site", "url", "found", "delay"), ["site", "url"], "__q_rank")
        begin = placed.groupBy("site").agg(F.min("__q_rank").alias("first")).join(sites, "site")
        wait = F.round(F.coalesce(F.col("delay") * 1000, F.lit(delay_ms))).cast("long")
        timed = placed.join(begin, "site").withColumn("start_ms", F.col("next_ms") + (F.col("__q_rank") - F.col("first")) * wait)
        # The page limit counts in order of addresses.
        pages_first = ranks(timed.filter("found").select("url"), ["url"], "__q_page")
        timed = timed.join(pages_first, "url", "left").withColumn("status", F.when(F.col("__q_page") > max_pages - fetched, "limit").when(F.col("found"), "fetched").otherwise("missing"))
        depth = F.lit(number).alias("depth")
        stopped = within.filter(~F.col("allowed")).select("url", depth, "site", F.lit("disallowed").alias("status"), F.lit(None).cast("long").alias("start_ms"))
        now = state.put("visited", number, timed.select("url", depth, "site", "status", F.when(F.col("status") != "limit", F.col("start_ms")).alias("start_ms")).unionByName(stopped))
        ended = timed.filter("status <> 'limit'").groupBy("site").agg(F.max(F.col("start_ms") + wait).alias("ended"))
        state.put("sites", number + 1, sites.join(ended, "site", "left").select("site", F.coalesce("ended", "next_ms").alias("next_ms")))
        read = now.filter("status = 'fetched'").select("url").join(store, "url")
        links = read.select(F.explode(page_links("html", "url")).alias("url")).select(normalise_url(F.col("url")).alias("url")).filter("url is not null").distinct()
        following = state.put("frontier", number + 1, links.join(state.visited(number).select("url"), "url", "left_anti"))
        state.close(number)
        number, done = number + 1, done + 1
        if following.isEmpty():
            break
    return state.visited(number - 1) if number else spark.createDataFrame([], "url string, depth int, site string, status string, start_ms long")
