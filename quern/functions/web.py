"""URL, robots and light HTML functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise_url(c: Column) -> Column:
    """No fragment, no default port; null unless http or https."""
    c = F.regexp_replace(c, "#.*", "")
    c = F.regexp_replace(c, r"^(http://[^/?]*):80(?=[/?]|$)", "$1")
    c = F.regexp_replace(c, r"^(https://[^/?]*):443(?=[/?]|$)", "$1")
    return F.when(c.rlike("^https?://[^/]"), c)


def domain(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def skipped(c: Column, parts: list[str]) -> Column:
    """The URL contains one of the parts, in any case."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(F.lower(c), F.lit(p.lower()))
    return out


def bot_name(c: Column) -> Column:
    return F.lower(F.split(c, r"[/\s]")[0])


def route(c: Column) -> Column:
    """/v1/models/<name> becomes its template."""
    return F.regexp_replace(c, r"^/v1/models/[^/]+", "/v1/models/{model_id}")


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def title(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_lang(c: Column) -> Column:
    return F.substring(F.regexp_extract(c, r"(?is)<html[^>]*\blang=[\"']?([A-Za-z\-]+)", 1), 1, 5)


def rule_pattern(rule: Column) -> Column:
    """A robots rule as a regular expression: * is anything, a final $ the end, else a prefix."""
    escaped = F.regexp_replace(rule, r"([.+?^()\[\]{}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(escaped, r"\*", ".*"))


def robots_allowed(requests: DataFrame, rules: DataFrame, bot: str) -> DataFrame:
    """requests(path) with allowed: the rules(agent, directive, rule) of the bot, else of *, decide; the longest that fits
    wins, allow before disallow. Rules are one site's list, so small; the join is a broadcast when they measure so."""
    named = F.lower("agent") == bot.lower()
    used = rules.filter(named | (F.col("agent") == "*")).withColumn("own", named.cast("int"))
    top = used.agg(F.max("own").alias("top"))
    used = used.join(F.broadcast(top), F.col("own") == F.col("top")).drop("own", "top")
    fits = (F.col("rule") == "") | F.rlike("path", rule_pattern(F.col("rule")))
    paths = requests.select("path").distinct()
    hit = paths.join(used, fits).groupBy("path").agg(F.max_by("directive", F.struct(F.length("rule"), (F.col("directive") == "allow").cast("int"))).alias("directive"))
    return requests.join(hit, "path", "left").withColumn("allowed", F.coalesce(F.col("directive") == "allow", F.lit(True))).drop("directive")


def robots_rules(lines: DataFrame) -> DataFrame:
    """agent, directive and rule from lines(site, number, line) of robots files: a group's agents hold for its rules."""
    from pyspark.sql import Window

    line = F.trim(F.regexp_replace("line", "#.*", ""))
    key = F.lower(F.trim(F.split(line, ":", 2)[0]))
    value = F.trim(F.split(line, ":", 2)[1])
    parsed = lines.select("site", "number", key.alias("key"), value.alias("value")).filter(F.col("key").isin("user-agent", "allow", "disallow"))
    by_site = Window.partitionBy("site").orderBy("number")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(by_site), F.lit("")) != "user-agent")
    grouped = parsed.withColumn("group", F.sum(starts.cast("int")).over(by_site))
    agents = grouped.filter("key = 'user-agent'").select("site", "group", F.lower("value").alias("agent"))
    rules = grouped.filter("key <> 'user-agent'").select("site", "group", F.col("key").alias("directive"), F.col("value").alias("rule"))
    return agents.join(rules, ["site", "group"]).select("site", "agent", "directive", "rule")
