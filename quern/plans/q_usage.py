"""Queries over events and the relational tables: usage, monitoring, joins, windows, pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.text import millis
from quern.operators import monitoring, usage
from quern.operators.dedup import first_rows
from quern.operators.corpus import ranks
from quern.plans.registry import query
from quern.session import table

U = "WITH u AS (SELECT event_id AS id, user_id % 10 AS org_id, user_id AS api_key_id, event_type AS endpoint, floor(value)::BIGINT AS total_tokens, value AS latency_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, ts AS created_at FROM events)"
RANGE = "created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-25'"
START, END = "2024-01-05 00:00:00", "2024-01-25 00:00:00"


def events(spark, sf):
    return table(spark, sf, "events")


def view(spark, sf):
    return usage.usage_view(events(spark, sf))


def org3(spark, sf):
    return usage.in_range(view(spark, sf), 3, START, END)


@query(f"{U} SELECT count(*) AS requests, coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens, floor(coalesce(avg(latency_ms), 0) + 0.5)::BIGINT AS avg_latency_ms FROM u WHERE org_id = 3 AND {RANGE}")
def a_overview(spark, sf):
    return usage.overview(org3(spark, sf))


@query(f"{U} SELECT api_key_id, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS requests FROM u WHERE org_id = 3 AND {RANGE} GROUP BY 1 ORDER BY total_tokens DESC, api_key_id LIMIT 10")
def a_by_key(spark, sf):
    return usage.by_key(org3(spark, sf))


@query(f"{U} SELECT endpoint, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS requests FROM u WHERE org_id = 3 AND {RANGE} GROUP BY 1")
def a_by_endpoint(spark, sf):
    return usage.by_endpoint(org3(spark, sf))


@query(f"{U} SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, count(*) AS requests, sum(total_tokens)::BIGINT AS total_tokens, floor(avg(latency_ms) + 0.5)::BIGINT AS avg_latency_ms FROM u WHERE org_id = 3 AND {RANGE} GROUP BY 1")
def a_timeline(spark, sf):
    return usage.timeline(org3(spark, sf))


_SUBS = [(0, "PRO", "ACTIVE", 1_000_000, 300), (1, "STARTER", "ACTIVE", 100_000, 60), (2, "PRO", "PAST_DUE", 1_000_000, 300)]


@query(f"""{U}, s(org_id, plan, status, tokens_per_day, requests_per_min) AS (VALUES (0, 'PRO', 'ACTIVE', 1000000, 300), (1, 'STARTER', 'ACTIVE', 100000, 60), (2, 'PRO', 'PAST_DUE', 1000000, 300)),
m AS (SELECT org_id, count(*) AS requests, sum(total_tokens)::BIGINT AS total_tokens FROM u WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-02-01' GROUP BY 1)
SELECT m.org_id, coalesce(plan, 'FREE') AS plan, coalesce(status, 'ACTIVE') AS status, requests, total_tokens, coalesce(tokens_per_day, 1000)::BIGINT AS tokens_per_day, coalesce(requests_per_min, 10)::BIGINT AS requests_per_min FROM m LEFT JOIN s ON s.org_id = m.org_id""")
def a_billing(spark, sf):
    subs = spark.createDataFrame(_SUBS, "org_id long, plan string, status string, tokens_per_day long, requests_per_min long")
    return usage.billing(view(spark, sf), subs, 2024, 1)


@query(f"{U} SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM nation) AS orgs, (SELECT count(DISTINCT api_key_id) FROM u) AS active_keys, (SELECT count(*) FROM u WHERE created_at >= TIMESTAMP '2024-01-15' AND created_at < TIMESTAMP '2024-01-16') AS requests_today, (SELECT coalesce(sum(total_tokens), 0)::BIGINT FROM u WHERE created_at >= TIMESTAMP '2024-01-15' AND created_at < TIMESTAMP '2024-01-16') AS tokens_today")
def a_platform(spark, sf):
    u = view(spark, sf)
    today = (F.col("created_at") >= F.lit("2024-01-15").cast("timestamp")) & (F.col("created_at") < F.lit("2024-01-16").cast("timestamp"))
    of_usage = u.agg(F.countDistinct("api_key_id").alias("active_keys"), F.count_if(today).alias("requests_today"), F.coalesce(F.sum(F.when(today, F.col("total_tokens"))), F.lit(0)).alias("tokens_today"))
    one = lambda t, n: table(spark, sf, t).agg(F.count("*").alias(n))
    return one("customer", "users").crossJoin(one("nation", "orgs")).crossJoin(of_usage)  # one row each


@query(f"{U} SELECT id, endpoint, total_tokens, latency_ms, status_code, (SELECT count(*) FROM u WHERE org_id = 3) AS total, (SELECT count(*) FROM u WHERE org_id = 3) > 50 AS has_more FROM u WHERE org_id = 3 ORDER BY created_at DESC, id LIMIT 25 OFFSET 25")
def o_page(spark, sf):
    rows = view(spark, sf).filter("org_id = 3").select("id", "endpoint", "total_tokens", "latency_ms", "status_code", "created_at")
    return usage.page(rows, [F.desc("created_at"), "id"], 2, 25).drop("created_at")


@query("SELECT strftime(time_bucket(INTERVAL 5 minutes, ts), '%Y-%m-%d %H:%M:%S') AS at, event_type, round(count(*) / 300, 6) AS rate FROM events GROUP BY 1, 2")
def m_rate_by(spark, sf):
    return _at(monitoring.rate_by(events(spark, sf), "event_type")).withColumn("rate", F.round("rate", 6))


def _at(df):
    return df.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS at, round(count_if(event_type = 'error') / count(*), 6) AS ratio FROM events GROUP BY 1 HAVING count_if(event_type = 'error') / count(*) > 0.05")
def m_error_ratio(spark, sf):
    return _at(monitoring.ratio(events(spark, sf), F.col("event_type") == "error").filter("ratio > 0.05")).withColumn("ratio", F.round("ratio", 6))


def _quantile_sql(q):
    from quern.operators.monitoring import BUCKETS

    parts = []
    for i, b in enumerate(BUCKETS):
        low, below = ("0.0", "0") if i == 0 else (str(BUCKETS[i - 1]), f"b{i - 1}")
        parts.append(f"WHEN b{i} >= n * {q}::DOUBLE THEN {low} + ({b}::DOUBLE - {low}) * (n * {q}::DOUBLE - {below}) / nullif(b{i} - {below}, 0)")
    counts = ", ".join(f"count_if(value <= {b}) AS b{i}" for i, b in enumerate(BUCKETS))
    return f"WITH h AS (SELECT event_type, {counts}, count(*) AS n FROM events GROUP BY 1) SELECT event_type, round(CASE {' '.join(parts)} ELSE {BUCKETS[-1]} END, 4) AS value FROM h"


def _quantile(name, q):
    def run(spark, sf):
        return monitoring.histogram_quantile(events(spark, sf), "value", q, by=["event_type"]).withColumn("value", F.round("value", 4))

    run.__name__ = name
    query(_quantile_sql(q))(run)


_quantile("m_quantile_p50", 0.5)
_quantile("m_quantile_p95", 0.95)
_quantile("m_quantile_p99", 0.99)


@query("SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS at, event_type, sum(floor(value))::BIGINT AS tokens FROM events GROUP BY 1, 2")
def m_tokens(spark, sf):
    return _at(events(spark, sf).groupBy(F.date_trunc("minute", "ts").alias("at"), "event_type").agg(F.sum(F.floor("value")).cast("long").alias("tokens")))


@query("SELECT user_id, round(sum(value), 2) AS used FROM events GROUP BY 1 HAVING sum(value) / 1500 > 0.4")
def m_ratio_gauge(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("used"), (F.sum("value") / 1500).alias("r")).filter("r > 0.4").drop("r")


@query("""WITH s AS (SELECT user_id, ts, event_id, json_extract_string(props, '$.k')::DOUBLE AS value FROM events), l AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS last FROM s)
SELECT user_id, strftime(time_bucket(INTERVAL 30 minutes, ts), '%Y-%m-%d %H:%M:%S') AS at, sum(CASE WHEN last IS NULL THEN 0.0 WHEN value < last THEN value ELSE value - last END) AS increase FROM l GROUP BY 1, 2""")
def m_increase(spark, sf):
    s = events(spark, sf).select("user_id", "ts", F.get_json_object("props", "$.k").cast("double").alias("value"))
    return _at(monitoring.increase(s, ["user_id"]))


@query("SELECT user_id, date_diff('day', max(ts)::DATE, DATE '2024-02-15') AS age_days FROM events GROUP BY 1 HAVING date_diff('day', max(ts)::DATE, DATE '2024-02-15') > 17")
def m_stale(spark, sf):
    age = F.datediff(F.lit("2024-02-15").cast("date"), F.max("ts").cast("date")).cast("long")
    return events(spark, sf).groupBy("user_id").agg(age.alias("age_days")).filter("age_days > 17")


@query("SELECT u.user_id, d.day FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events) d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND strftime(e.ts, '%Y-%m-%d') = d.day)")
def m_absent(spark, sf):
    e = events(spark, sf).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    # The expected series: users by days, a calendar that is bounded.
    expected = e.select("user_id").distinct().crossJoin(F.broadcast(e.select("day").distinct()))
    return monitoring.absent(expected, e, ["user_id", "day"])


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS h, count_if(event_type = 'error') / count(*) > 0.02 AS bad FROM events GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY h) - row_number() OVER (PARTITION BY bad ORDER BY h) AS g FROM h)
SELECT strftime(min(h), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(h), '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS points FROM i WHERE bad GROUP BY g HAVING count(*) >= 3""")
def m_for(spark, sf):
    p = monitoring.ratio(events(spark, sf), F.col("event_type") == "error").select(F.lit(1).alias("series"), "at", (F.col("ratio") > 0.02).alias("bad"))
    runs = monitoring.held_for(p, ["series"], "at", "bad", 3)
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return runs.select(f("start"), f("end"), "points")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS at, round(count_if(event_type = 'signup') / count(*), 6) AS ratio FROM events GROUP BY 1")
def m_limit_rate(spark, sf):
    return _at(monitoring.ratio(events(spark, sf), F.col("event_type") == "signup", 86_400)).withColumn("ratio", F.round("ratio", 6))


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(list_sort(list(value))[greatest(1, floor(0.95 * count(*))::INT)], 6) AS p95, max(value) AS max FROM events WHERE event_type = 'purchase'")
def a_latency(spark, sf):
    """Order statistics by rank in a global sort: no task holds the values."""
    v = events(spark, sf).filter("event_type = 'purchase'")
    ranked = ranks(v.select("value").filter("value IS NOT NULL"), ["value"], "r")
    n = ranked.count()
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("value")))
    picked = ranked.agg(F.round(at(max(1, int(0.95 * n))), 6).alias("p95"), F.round((at((n + 1) // 2) + at(n // 2 + 1)) / 2, 6).alias("median"))
    return v.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max")).crossJoin(F.broadcast(picked))  # one row


@query()
def st_sliding_limit(spark, sf):
    r = events(spark, sf).select((F.col("user_id") % 10).alias("key"), F.col("event_id").alias("id"), millis(F.col("ts")).alias("ts_ms"))
    return usage.replay_limit(r, 10, 3_600_000)


@query(f"""{U}, d AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS day, coalesce(sum(total_tokens) OVER (PARTITION BY org_id, strftime(created_at, '%Y-%m-%d') ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM u)
SELECT id, org_id, day, least(b, max(CASE WHEN b < 300 THEN b + total_tokens END) OVER (PARTITION BY org_id, day))::BIGINT AS used_before, b < 300 AS allowed FROM d""")
def st_daily_quota(spark, sf):
    return usage.replay_quota(view(spark, sf), 300)


@query("SELECT event_id AS id, pmod AS shard FROM (SELECT event_id, event_id % 4 AS pmod FROM events)")
def st_shard(spark, sf):
    return events(spark, sf).select(F.col("event_id").alias("id"), F.pmod("event_id", F.lit(4)).alias("shard"))


@query("""WITH r AS (SELECT user_id % 20 AS domain, event_id AS id, (epoch_us(ts) // 1000)::BIGINT AS ts_ms FROM events), i AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts_ms, id) AS i FROM r)
SELECT domain, id, ts_ms, (max(ts_ms - i * 600000) OVER (PARTITION BY domain ORDER BY ts_ms, id ROWS UNBOUNDED PRECEDING) + i * 600000)::BIGINT AS start_ms FROM i""")
def st_domain_delay(spark, sf):
    r = events(spark, sf).select((F.col("user_id") % 20).alias("domain"), F.col("event_id").alias("id"), millis(F.col("ts")).alias("ts_ms"))
    return usage.domain_schedule(r, 600_000)


@query("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark, sf):
    g = events(spark, sf).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type", "n", "total")


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 hours THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, g""")
def ext_sessions(spark, sf):
    g = events(spark, sf).groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def tpch(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


@query("SELECT o_orderkey, c_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def j_left_nested(spark, sf):
    o, c = tpch(spark, sf, "orders", "customer")
    nested = o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", F.struct("c_custkey", "c_name").alias("customer"))
    return nested.select("o_orderkey", "customer.c_custkey", "customer.c_name")


@query("SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j_one_many(spark, sf):
    o, c = tpch(spark, sf, "orders", "customer")
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return c.join(lists, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), F.lit("")).alias("orders"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def j_chain(spark, sf):
    c, n, r = tpch(spark, sf, "customer", "nation", "region")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def j_count_rel(spark, sf):
    n, c, s = tpch(spark, sf, "nation", "customer", "supplier")
    cc = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    sc = s.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    out = n.join(cc, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(sc, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return out.select("n_nationkey", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def j_semi_anti(spark, sf):
    c, o, n = tpch(spark, sf, "customer", "orders", "nation")
    left = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return left.join(n.filter("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query("""WITH r(prefix, scope) AS (VALUES ('http://', 'plain'), ('https://', 'secure'), ('https://www.', 'www'), ('https://blog.', 'blog')), m AS (SELECT page_id, prefix, scope, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC) AS n FROM pages JOIN r ON starts_with(url, prefix)) SELECT page_id, scope FROM m WHERE n = 1""")
def j_longest_prefix(spark, sf):
    rules = spark.createDataFrame([("http://", "plain"), ("https://", "secure"), ("https://www.", "www"), ("https://blog.", "blog")], "prefix string, scope string")
    hit = table(spark, sf, "pages").select("page_id", "url").join(F.broadcast(rules), F.expr("startswith(url, prefix)"))  # four rules
    return hit.groupBy("page_id").agg(F.max_by("scope", F.length("prefix")).alias("scope"))


@query("SELECT e.event_id, coalesce(l.id, 1) AS token_id FROM events e LEFT JOIN (VALUES ('view', 12), ('click', 13), ('purchase', 14)) l(token, id) ON l.token = e.event_type")
def j_lookup(spark, sf):
    vocab = spark.createDataFrame([("view", 12), ("click", 13), ("purchase", 14)], "token string, id int")
    return events(spark, sf).join(F.broadcast(vocab), F.col("token") == F.col("event_type"), "left").select("event_id", F.coalesce("id", F.lit(1)).alias("token_id"))  # three rows


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def w_first(spark, sf):
    return first_rows(events(spark, sf), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f)::INT AS rank FROM c")
def w_rank(spark, sf):
    c = events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    return c.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "f")).alias("rank"))


@query("SELECT user_id, event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events")
def w_next(spark, sf):
    return events(spark, sf).select("user_id", "event_id", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_type"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20")
def w_replay(spark, sf):
    """The newest 20 of each user: a replay buffer's content."""
    return first_n(events(spark, sf), 20).select("user_id", "event_id")


def first_n(df, n):
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


@query("SELECT s.step, round(CASE WHEN s.step < 100 THEN s.step / 100.0 ELSE greatest(0.0, 0.5 * (1 + cos(pi() * (s.step - 100) / 900.0))) END, 8) AS factor FROM (SELECT unnest(range(0, 1001))::INT AS step) s")
def w_lr(spark, sf):
    """Warm-up over 100 steps, then a cosine to 1000."""
    s = spark.range(0, 1001).select(F.col("id").cast("int").alias("step"))
    cosine = F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.pi() * (F.col("step") - 100) / 900.0)))
    return s.select("step", F.round(F.when(F.col("step") < 100, F.col("step") / 100.0).otherwise(cosine), 8).alias("factor"))


@query("""WITH t AS (SELECT conv_id, turn, role, greatest(1, length(text) // 4) AS n FROM conversations), r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM t WHERE role <> 'system'),
b AS (SELECT conv_id, coalesce(sum(n), 0) AS used FROM t WHERE role = 'system' GROUP BY 1)
SELECT r.conv_id, turn FROM r LEFT JOIN b ON b.conv_id = r.conv_id WHERE s <= 300 - coalesce(used, 0) UNION ALL SELECT conv_id, turn FROM t WHERE role = 'system'""")
def w_budget_tail(spark, sf):
    from quern.operators.training import budget_tail

    return budget_tail(table(spark, sf, "conversations"), 300).select("conv_id", "turn")


@query("""WITH p AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type), c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT user_id, event_type, round(p, 6) AS p FROM c WHERE before <= 0.8""")
def w_topp(spark, sf):
    """The nucleus of each user's event types: those before which at most 0.8 has been gathered."""
    c = events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    w = Window.partitionBy("user_id").orderBy(F.desc("p"), "event_type").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("before", F.coalesce(F.sum("p").over(w), F.lit(0.0))).filter("before <= 0.8").select("user_id", "event_type", F.round("p", 6).alias("p"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def s_distinct(spark, sf):
    return events(spark, sf).select("user_id", "event_type").distinct()


@query("SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup'")
def s_except(spark, sf):
    e = events(spark, sf)
    return e.filter("event_type = 'view'").select("user_id").subtract(e.filter("event_type = 'signup'").select("user_id"))


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def s_intersect(spark, sf):
    e = events(spark, sf)
    return e.filter("event_type = 'purchase'").select("user_id").intersect(e.filter("event_type = 'error'").select("user_id"))


@query("SELECT c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier")
def s_union(spark, sf):
    c, s = tpch(spark, sf, "customer", "supplier")
    return c.select(F.col("c_name").alias("name"), F.lit("customer").alias("kind")).unionByName(s.select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind")))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def o_max_docs(spark, sf):
    return table(spark, sf, "documents").orderBy("doc_id").limit(100).select("doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def o_list(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month FROM events")
def json_and_dates(spark, sf):
    return events(spark, sf).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.date_format(F.date_trunc("month", "ts"), "yyyy-MM-dd").alias("month"))


@query("SELECT s_suppkey, substr(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 63) AS slug FROM supplier")
def slug(spark, sf):
    from quern.functions.text import slug as f

    return table(spark, sf, "supplier").select("s_suppkey", f(F.col("s_name")).alias("slug"))


@query("SELECT c_custkey, c_acctbal > 0 AND c_custkey % 7 <> 0 AS valid, c_mktsegment IN ('BUILDING', 'MACHINERY') AS scoped FROM customer")
def f_key_valid(spark, sf):
    """Active and unexpired; and an array of scopes that holds the wanted one."""
    scopes = F.array(F.lit("BUILDING"), F.lit("MACHINERY"))
    return table(spark, sf, "customer").select("c_custkey", ((F.col("c_acctbal") > 0) & (F.col("c_custkey") % 7 != 0)).alias("valid"), F.array_contains(scopes, F.col("c_mktsegment")).alias("scoped"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a_lineitem(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
