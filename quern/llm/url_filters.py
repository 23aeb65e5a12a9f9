"""URL filters: explicit rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are shrunk through beta-binomial priors: all pages to suffix, suffix to registered
domain, domain to host. At each level the prior's mean is the parent's posterior mean and its strength comes from the
moments of all units of that level, but is that of ``LEAST_STRENGTH`` pages at least, so that no single page decides, and
no more than the parent's posterior itself rests on. A host whose lower posterior bound of the bad share exceeds ``max_bad`` is blocked.

For its reputation a host is taken without user, port and final dots. Its suffix is its last label, or the last two if
``SUFFIXES`` has them, its registered domain one label more; an address is its own domain, without a suffix.

Defined cases: an empty table gives an empty result; other columns are ignored; a null url or one without ``://`` has an empty host and path, which no rule fits; hosts without labels take
their domain's, suffix's or the overall estimate; repeated rows each keep a row; repeated labels of one page each count;
without any labels nothing is blocked by reputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import salted_join
from quern.plans.lineage import written

#: (verdict, rule): longest fitting rule wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Public suffixes of two labels.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg",
    "com.es", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.pt", "com.sg", "com.tr", "com.tw", "com.ua", "com.ve", "com.vn", "edu.au", "edu.cn", "go.jp", "gob.mx",
    "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "govt.nz", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "or.jp", "or.kr", "org.ar", "org.au", "org.br", "org.cn", "org.in", "org.mx",
    "org.nz", "org.tr", "org.tw", "org.uk", "org.za", "sch.uk",
)
MAX_BAD, BOUND_SDS = 0.5, 1.645
LEAST_STRENGTH = 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def unit_of(host: Column) -> Column:
    """The host whose reputation counts: without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(host, r"([^@]*)$", 1), r":[0-9]*$", ""), r"\.+$", "")


def is_address(unit: Column) -> Column:
    return unit.startswith("[") | unit.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")


def domain_of(unit: Column) -> Column:
    """The registered domain."""
    two = F.substring_index(unit, ".", -2)
    return F.when(is_address(unit), unit).when(two.isin(*SUFFIXES), F.substring_index(unit, ".", -3)).otherwise(two)


def suffix_of(unit: Column) -> Column:
    two = F.substring_index(unit, ".", -2)
    return F.when(is_address(unit), "").when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(unit, ".", -1))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits a host (or a domain above it) and starts the path; null if none does."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = rule.partition("/")
        out = F.when(((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest), F.lit(rule)).otherwise(out)
    return out


def reputation(outcomes: DataFrame, max_bad: float = MAX_BAD, sds: float = BOUND_SDS) -> DataFrame:
    """host, n, bad, a, b (the posterior) and blocked, from outcomes(host, bad: 1, 0 or null for unlabelled pages). Each level
    is stored, a row a host at most, and read by what follows."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = written(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k"), "hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    overall = suffixes.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("m"), (F.sum("n") + 2).alias("t"))
    parent = lambda key: level.select(key, F.col("mean").alias("m"), (F.col("a") + F.col("b")).alias("t"))
    level = shrunk(written(suffixes.crossJoin(F.broadcast(overall)), "units"))  # one row of totals
    units = salted_join(domains, parent("suffix"), "suffix")
    level = shrunk(written(units, "units"))
    units = salted_join(hosts.drop("suffix"), parent("domain"), "domain")
    level = shrunk(written(units, "units"))
    bound = F.col("mean") - sds * F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1)))
    return level.select("host", "n", F.col("k").alias("bad"), "a", "b", (bound > max_bad).alias("blocked"))


def shrunk(units: DataFrame) -> DataFrame:
    """units(n, k, m and t: the parent's mean and weight) with the posterior a, b and its mean; the strength is found by moments."""
    seen = F.col("n") > 0
    spread = F.col("m") * (1 - F.col("m"))
    moments = units.agg(
        F.sum(F.when(seen, F.col("n") * (F.col("k") / F.col("n") - F.col("m")) * (F.col("k") / F.col("n") - F.col("m")) - spread)).alias("over"),
        F.sum(F.when(seen, spread * (F.col("n") - 1))).alias("room"),
    )
    rho = F.coalesce(F.when(F.col("room") > 0, F.col("over") / F.col("room")), F.lit(0.0))
    rho = F.greatest(F.lit(0.0001), F.least(F.lit(0.9999), rho))
    out = units.crossJoin(F.broadcast(moments.select(F.greatest(F.lit(LEAST_STRENGTH), (1 - rho) / rho).alias("strength"))))  # one row
    out = out.withColumn("strength", F.least("strength", "t"))
    out = out.withColumn("a", F.col("m") * F.col("strength") + F.col("k")).withColumn("b", (1 - F.col("m")) * F.col("strength") + F.col("n") - F.col("k"))
    return out.withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))).drop("strength", "m", "t")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD, sds: float = BOUND_SDS) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages(page_id, url); labels(doc_id, quality, toxic) are the
    outcomes of the pages with those ids: bad if quality is 0 or toxic is 1."""
    url = F.col("url")
    pages = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("unit", unit_of(F.col("host")))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0)
    named = pages.select("page_id", F.col("unit").alias("host"))
    # Pages without an id have no outcome; they do not meet in the join's one place for nulls.
    outcomes = named.filter("page_id IS NOT NULL").join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id", "left").select("host", "bad")
    outcomes = outcomes.unionByName(named.filter("page_id IS NULL").select("host", F.lit(None).cast("int").alias("bad")))
    blocked = reputation(outcomes, max_bad, sds).filter("blocked").select(F.col("host").alias("unit"), "blocked")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    of_rule = F.coalesce(*[F.when(F.col("rule") == r, v) for v, r in rules], F.lit(None).cast("string")) if rules else F.lit(None)
    verdict = F.coalesce(of_rule, F.when(F.col("blocked"), "block").otherwise("allow"))
    return salted_join(pages.withColumn("rule", rule), blocked, "unit", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _level(name: str, units: str, parent: str, keys: str) -> str:
    return f"""
{name}_u AS (SELECT u.*, {parent}.mean AS m, {parent}.weight AS t FROM {units} u JOIN (SELECT {keys}, mean, weight FROM {parent}) {parent} USING ({keys})),
{name}_s AS (SELECT greatest({LEAST_STRENGTH}::DOUBLE, (1 - r) / r) AS strength FROM (SELECT greatest(0.0001::DOUBLE, least(0.9999::DOUBLE, coalesce(CASE WHEN sum(CASE WHEN n > 0 THEN m * (1 - m) * (n - 1) END) > 0
  THEN sum(CASE WHEN n > 0 THEN n * (k / n - m) * (k / n - m) - m * (1 - m) END) / sum(CASE WHEN n > 0 THEN m * (1 - m) * (n - 1) END) END, 0.0::DOUBLE))) AS r FROM {name}_u)),
{name} AS (SELECT * EXCLUDE (m, t, s), m * s + k AS a, (1 - m) * s + n - k AS b, (m * s + k) / (s + n) AS mean, s + n AS weight FROM (SELECT *, least(strength, t) AS s FROM {name}_u, {name}_s))"""


SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
units AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(host, '([^@]*)$', 1), ':[0-9]*$', ''), '\\.+$', '') AS unit FROM p),
parts AS (SELECT DISTINCT unit, starts_with(unit, '[') OR regexp_full_match(unit, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') AS address, string_split(unit, '.') AS l, array_to_string(string_split(unit, '.')[-2:], '.') AS two FROM units),
known AS (SELECT unit, CASE WHEN address THEN unit WHEN two IN {SUFFIXES} THEN array_to_string(l[-3:], '.') ELSE two END AS domain, CASE WHEN address THEN '' WHEN two IN {SUFFIXES} THEN two ELSE l[-1] END AS suffix FROM parts),
hosts AS (SELECT unit AS host, domain, suffix, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k
  FROM (SELECT unit, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END AS bad FROM units LEFT JOIN labels ON doc_id = page_id) JOIN known USING (unit) GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
overall AS (SELECT suffix, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM suffixes) AS mean, (SELECT sum(n) + 2 FROM suffixes) AS weight FROM suffixes),
{_level("s", "suffixes", "overall", "suffix")},{_level("d", "domains", "s", "suffix")},{_level("h", "hosts", "d", "domain, suffix")},
ruled AS (SELECT units.*, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM units)
SELECT page_id, ruled.host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN h.a / (h.a + h.b) - {BOUND_SDS} * sqrt(h.a * h.b / ((h.a + h.b) * (h.a + h.b) * (h.a + h.b + 1))) > {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN h ON h.host = ruled.unit
"""
