"""Robots files: a table function of their directives, and the rules of one bot for each site.

In SQL: ``SELECT site, d.* FROM files, LATERAL robots_directives(content) d`` once ``register`` was called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quern.functions.web import domain

#: Fixed value: the least delay between two requests to a site, in seconds.
LEAST_DELAY = 0.1


@udtf(returnType="line int, agent string, directive string, value string")
class Directives:
    """One row a directive of a robots file and agent it holds for. Agents named since the last blank line share what
    follows; a comment alone is a blank line; sitemaps have no agent; delays that are no numbers are left out."""

    def eval(self, content: str) -> Iterator[tuple]:
        agents: list[str] = []
        for n, raw in enumerate((content or "").splitlines(), 1):
            line = raw.split("#", 1)[0].strip()
            if not line:
                agents = []
            field, colon, value = line.partition(":")
            field, value = field.strip().lower(), value.strip()
            if not colon:
                continue
            if field == "user-agent":
                agents.append(value.lower())
            elif field == "sitemap":
                yield n, None, field, value
            elif field in ("allow", "disallow") or (field == "crawl-delay" and _number(value)):
                for agent in agents:
                    yield n, agent, field, value


def _number(text: str) -> bool:
    try:
        return math.isfinite(float(text))
    except ValueError:
        return False


def register(spark: SparkSession) -> None:
    spark.udtf.register("robots_directives", Directives)


def directives(files: DataFrame, content: str = "content") -> DataFrame:
    """files with a row for each directive: line, agent, directive and value."""
    return files.lateralJoin(Directives(F.col(content).outer())).drop(content)


def pattern(rule: Column) -> Column:
    """A rule as a regular expression for the start of a path: * is anything, $ the end."""
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(rule, r"([.+?^()\[\]{}|\\])", r"\\$1"), r"\*", ".*"))


def rules_of(parsed: DataFrame, bot: str, site: str = "site") -> DataFrame:
    """site, rules (pattern, length, allow) and delay of directives for a bot: those of its own name where there are any,
    else those of *. Rules and delays are looked up apart. One row a site; a file's size bounds its rules."""
    kind = F.when(F.col("directive") == "crawl-delay", "delay").otherwise("rule")
    own = parsed.filter(F.col("directive") != "sitemap").filter((F.col("agent") == bot.lower()) | (F.col("agent") == "*"))
    own = own.withColumn("kind", kind).withColumn("named", F.col("agent") == bot.lower())
    rule = F.struct(pattern(F.col("value")).alias("pattern"), F.length("value").alias("length"), (F.col("directive") == "allow").alias("allow"))
    lists = own.groupBy(site, "kind", "named").agg(F.collect_set(F.when(F.col("kind") == "rule", rule)).alias("rules"), F.max_by(F.col("value").try_cast("double"), "line").alias("delay"))
    rules = lists.filter("kind = 'rule'").groupBy(site).agg(F.max_by("rules", "named").alias("rules"))
    delays = lists.filter("kind = 'delay'").groupBy(site).agg(F.max_by("delay", "named").alias("delay"))
    return rules.join(delays, site, "full").select(site, F.coalesce("rules", F.array().cast("array<struct<pattern:string,length:int,allow:boolean>>")).alias("rules"), "delay")


def allowed(path: Column, rules: Column) -> Column:
    """Whether a path may be fetched: of the rules that fit it the longest decides, allow before disallow; none allows it."""
    fit = F.filter(rules, lambda r: F.rlike(path, r["pattern"]))
    best = F.array_max(F.transform(fit, lambda r: F.struct(r["length"].alias("length"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def judged(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with site, allowed and delay (seconds, null where the site names none), by rules_of. Sites without a file allow
    everything. Each site's rules are one row; frequent sites meet theirs where their addresses are."""
    from quern.operators.joins import by_parts
    from quern.plans.lineage import written

    sited = urls.withColumn("site", domain(F.col(url)))
    few = written(sited.groupBy("site").agg(F.count("*").alias("__q_n")).join(rules, "site", "left"), "rules")
    met = by_parts(sited, few, ["site"], "__q_n")
    named = F.coalesce(F.col("delay"), F.lit(0.0))
    # The evaluation needs no rules where there are none.
    ok = F.when(F.size(F.coalesce(F.col("rules"), F.array().cast("array<struct<pattern:string,length:int,allow:boolean>>"))) == 0, True).otherwise(allowed(path_of(F.col(url)), F.col("rules")))
    return met.withColumn("allowed", ok).withColumn("delay", F.when(named != 0, F.greatest(named, F.lit(LEAST_DELAY)))).drop("rules", "__q_n")
