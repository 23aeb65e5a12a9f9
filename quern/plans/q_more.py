"""Queries for the remaining operators of the inventory."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text, web
from quern.functions.numbers import rounded
from quern.operators import corpus, dedup, usage, vectors
from quern.plans.lineage import folder
from quern.plans.registry import query
from quern.session import table
from quern.sources import files


def events(spark, sf):
    return table(spark, sf, "events")


@query("SELECT event_id, regexp_replace('/v1/models/' || event_type || '/' || (event_id % 3), '^/v1/models/[^/]+', '/v1/models/{model_id}') AS route FROM events")
def path_norm(spark, sf):
    return events(spark, sf).select("event_id", web.route(F.concat(F.lit("/v1/models/"), "event_type", F.lit("/"), (F.col("event_id") % 3).cast("string"))).alias("route"))


@query("SELECT event_id, lower(event_type) AS bot FROM events")
def bot_name(spark, sf):
    return events(spark, sf).select("event_id", web.bot_name(F.concat(F.initcap("event_type"), F.lit("/1.0 (x)"))).alias("bot"))


@query(r"""WITH m AS (SELECT item_id, '== ' || item_id || ' ==' || chr(10) || '[[a|' || text || ']] {{gone}} ''''''b''''''' AS t FROM benchmark)
SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\{\{[^}]*\}\}', '', 'g'), '\[\[(?:File|Category|Image):[^\]]*\]\]', '', 'g'), '\[\[[^|\]]*\|([^\]]*)\]\]', '\1', 'g'), '\[\[([^\]]*)\]\]', '\1', 'g'), '={2,}([^=]+)={2,}', '\1', 'g'), '''{2,3}', '', 'g'), ' ' || chr(10)) AS value FROM m""")
def wiki_markup(spark, sf):
    t = F.concat(F.lit("== "), F.col("item_id").cast("string"), F.lit(" ==\n[[a|"), F.col("text"), F.lit("]] {{gone}} '''b'''"))
    return table(spark, sf, "benchmark").select("item_id", text.wiki_plain(t).alias("value"))


@query("SELECT page_id, octet_length(encode(html)) <= 4000 AS small, regexp_matches(html, '^<!DOCTYPE html') AS is_html FROM pages")
def f_body_size(spark, sf):
    """Bodies of at most a number of bytes, of an accepted kind."""
    return table(spark, sf, "pages").select("page_id", (F.octet_length("html") <= 4000).alias("small"), F.rlike("html", F.lit("^<!DOCTYPE html")).alias("is_html"))


@query("SELECT c_custkey, (c_custkey % 5 = 0) OR c_mktsegment = 'BUILDING' AS allowed, c_custkey % 3 = 0 AS subscribed FROM customer")
def f_scope(spark, sf):
    """A scope list that holds the wanted scope or the one for everything; an event list that holds an event."""
    scopes = F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("admin:all"))).otherwise(F.array(F.col("c_mktsegment")))
    listed = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("quota.reached"), F.lit("key.made"))).otherwise(F.array(F.lit("key.made")))
    allowed = F.array_contains(scopes, "BUILDING") | F.array_contains(scopes, "admin:all")
    return table(spark, sf, "customer").select("c_custkey", allowed.alias("allowed"), F.array_contains(listed, "quota.reached").alias("subscribed"))


@query("SELECT count(*) AS words, floor(count(*) * 1.3)::BIGINT AS tokens FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) FROM documents)")
def token_estimate(spark, sf):
    n = table(spark, sf, "documents").agg(F.sum(text.word_count(F.col("text"))).cast("long").alias("words"))
    return n.select("words", corpus.tokens_of(F.col("words")).alias("tokens"))


@query("WITH v AS (SELECT vec_id, embedding[1:8] AS x FROM embeddings) SELECT vec_id, generate_subscripts(x, 1) - 1 AS i, round(unnest(x)::DOUBLE, 5) AS x FROM v")
def emb_truncate(spark, sf):
    """The first eight components of every vector."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("i", "x"))
    return e.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query()
def w_welford(spark, sf):
    """Running mean and variance of discounted returns per user, seeded with variance 1; normalised and clipped at 10."""

    def each(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("event_id")
        mean, var, n, ret, out = 0.0, 1.0, 0, 0.0, []
        for r in f["value"]:
            ret = 0.99 * ret + r
            n += 1
            d = ret - mean
            mean += d / n
            var += (d * (ret - mean) - var) / n
            out.append(float(np.clip(r / np.sqrt(max(var, 1e-8)), -10, 10)))
        return pd.DataFrame({"user_id": f["user_id"], "event_id": f["event_id"], "normalised": out})

    return events(spark, sf).select("user_id", "event_id", "value").groupBy("user_id").applyInPandas(each, "user_id long, event_id long, normalised double")


@query("""WITH p AS (SELECT user_id, event_id, value AS priority FROM events), c AS (SELECT *, sum(priority) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS high, sum(priority) OVER (PARTITION BY user_id) AS total, count(*) OVER (PARTITION BY user_id) AS n FROM p)
SELECT user_id, event_id, round(power(n * priority / total + 1e-6, -0.4), 6) AS weight FROM c WHERE floor((high - priority) / total * 8 - 0.5) <> floor(high / total * 8 - 0.5)""")
def w_priority(spark, sf):
    """One row for the middle of each of eight strata of a user's cumulative priorities, with its importance weight.

    A sum on the border of two strata falls to the side that its rounding gives, so sums are added in the order of the SQL's
    engine: totals one by one, cumulative ones over nodes of 16 rows, of 16 nodes and so on."""
    whole = Window.partitionBy("user_id")
    rows = events(spark, sf).select("user_id", "event_id", F.col("value").alias("p"), F.monotonically_increasing_id().alias("at"))
    dealt = rows.repartition("user_id").sortWithinPartitions("user_id", F.asc_nulls_last("event_id"), "at")
    c = dealt.select("user_id", "event_id", "p", F.sum("p").over(whole).alias("total"), F.count("*").over(whole).alias("n"))

    def each(batches):
        user, sums = object(), None
        for batch in batches:
            users, values = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            high = np.zeros(len(users))
            for i, (u, v) in enumerate(zip(users, values, strict=True)):
                if sums is None or u != user:
                    user, sums = u, usage.NodeSums()
                high[i] = sums.add(v)
            p, total, n = (batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            with np.errstate(all="ignore"):
                before, after = (np.floor(x / total * 8 - 0.5) for x in (high - p, high))
                weight = np.power(n * p / total + 1e-6, -0.4)
            hit = (before != after) & ~(np.isnan(before) & np.isnan(after)) & batch.column(2).is_valid().to_numpy(zero_copy_only=False) & batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weight)], ["user_id", "event_id", "weight"])
            yield out.filter(pa.array(hit))

    hit = c.mapInArrow(each, "user_id long, event_id long, weight double")
    return hit.select("user_id", "event_id", rounded(F.col("weight"), 6).alias("weight"))


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 25")
def w_reservoir(spark, sf):
    """A seeded uniform sample of fixed size: the least hashes, from partial tops."""
    return table(spark, sf, "documents").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id").limit(25).select("doc_id")


@query("SELECT round(sum(value) / count(*), 6) AS loss, round(exp(least(sum(value) / count(*), 20)), 4) AS perplexity, count(*) AS tokens FROM events WHERE event_type <> 'error'")
def a_eval(spark, sf):
    """Mean loss over the tokens that count, and its perplexity."""
    e = events(spark, sf).filter("event_type <> 'error'")
    mean = F.sum("value") / F.count("*")
    return e.agg(F.round(mean, 6).alias("loss"), F.round(F.exp(F.least(mean, F.lit(20.0))), 4).alias("perplexity"), F.count("*").alias("tokens"))


@query("WITH m AS (SELECT label AS model, count(*) AS files, count_if(list_contains(list_transform(embedding, lambda x: isnan(x) OR isinf(x)), true))::BIGINT AS broken, min(len(embedding)) = max(len(embedding)) AS same_size FROM embeddings GROUP BY 1) SELECT model, files, broken, same_size, broken = 0 AND same_size AS passed FROM m")
def g_checkpoint(spark, sf):
    """No value of a model's arrays is NaN or infinite, and all sizes agree."""
    bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    m = table(spark, sf, "embeddings").groupBy(F.col("label").alias("model")).agg(F.count("*").alias("files"), F.count_if(bad).alias("broken"), (F.min(F.size("embedding")) == F.max(F.size("embedding"))).alias("same_size"))
    return m.withColumn("passed", (F.col("broken") == 0) & F.col("same_size"))


@query("SELECT user_id AS model, max(event_id) AS latest, max(CASE WHEN event_id < m THEN event_id END) AS rollback_to FROM (SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY 1")
def g_versions(spark, sf):
    """Each model's latest version and the one to roll back to."""
    e = events(spark, sf).groupBy("user_id").agg(F.slice(F.sort_array(F.collect_set("event_id"), asc=False), 1, 2).alias("v"))
    return e.select(F.col("user_id").alias("model"), F.col("v")[0].alias("latest"), F.try_element_at("v", F.lit(2)).alias("rollback_to"))


@query("SELECT label AS model, round(exp(avg(abs(embedding[1]::DOUBLE)) * 10), 4) AS perplexity, exp(avg(abs(embedding[1]::DOUBLE)) * 10) < 3 AS passed FROM embeddings GROUP BY 1")
def g_perplexity(spark, sf):
    p = F.exp(F.avg(F.abs(F.col("embedding")[0].cast("double"))) * 10)
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("model")).agg(F.round(p, 4).alias("perplexity"), (p < 3).alias("passed"))


@query()
def g_sha(spark, sf):
    from quern.sources.files import file_hashes

    return file_hashes(spark, f"{sf}/nation.parquet").select("size", "sha256", "md5")


@query("SELECT (epoch_us(ts) // 3600000000)::BIGINT AS hour, count(*) AS requests, round(count(*) / 16.0, 4) AS batches FROM events GROUP BY 1")
def st_micro_batch(spark, sf):
    """What dispatching at 16 requests makes of each hour."""
    hour = F.floor(text.millis(F.col("ts")) / 3_600_000).alias("hour")
    return events(spark, sf).groupBy(hour).agg(F.count("*").alias("requests"), F.round(F.count("*") / 16.0, 4).alias("batches"))


@query("SELECT org_id, day, sum(tokens)::BIGINT AS used FROM (SELECT user_id % 10 AS org_id, strftime(ts, '%Y-%m-%d') AS day, floor(value)::BIGINT AS tokens FROM events) GROUP BY 1, 2")
def st_usage_queue(spark, sf):
    """The counters that the usage sink keeps by org and day; a new day is a new key, so nothing is reset."""
    from quern.operators.usage import usage_view

    return usage_view(events(spark, sf)).groupBy("org_id", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.sum("total_tokens").alias("used"))


@query()
def st_shuffle_buffer(spark, sf):
    from quern.streaming.limits import shuffled

    return shuffled(events(spark, sf).select("event_id", "user_id"), 500)


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS chunk FROM documents")
def snk_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return corpus.ranks(d, ["doc_id"], "r").select("doc_id", F.floor((F.col("r") - 1) / 100).alias("chunk"))


@query("SELECT doc_id, text FROM documents WHERE length(text) > 0")
def snk_jsonl(spark, sf):
    """Written as JSON lines and read again."""
    import uuid

    from quern.plans.lineage import shared_folder

    path = f"{shared_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(table(spark, sf, "documents").select("doc_id", "text").filter("length(text) > 0"), path)
    return files.read_jsonl(spark, path, "doc_id long, text string")


@query("SELECT label, round(regr_slope(x2, x1), 4) AS slope, round(corr(x1, x2), 4) AS corr FROM (SELECT label, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2 FROM embeddings) GROUP BY 1")
def v_slope(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x1"), F.col("embedding")[1].cast("double").alias("x2"))
    return e.groupBy("label").agg(F.round(F.regr_slope("x2", "x1"), 4).alias("slope"), F.round(F.corr("x1", "x2"), 4).alias("corr"))


@query("SELECT conv_id, turn, role, left(text, 500) AS passage, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS number FROM conversations")
def v_format(spark, sf):
    """Numbered passages of at most 500 characters."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.substring("text", 1, 500).alias("passage"), F.row_number().over(w).alias("number"))


@query("""SELECT e.vec_id, q.vec_id AS query_id, round(sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 4) AS distance
FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q""")
def j_cross_dist(spark, sf):
    """Distances of all vectors to a stated query set: those whose id is divisible by 50."""
    e = table(spark, sf, "embeddings")
    return vectors.distances(e, e.filter("vec_id % 50 = 0")).withColumn("distance", F.round("distance", 4))


@query("WITH c AS (SELECT item_id, list_filter(string_split(text, ''), lambda c: c <> ' ') AS c FROM benchmark) SELECT item_id, array_to_string(c, '') AS text FROM c")
def tk_decode(spark, sf):
    """Ids of characters decoded back through a vocabulary table, special ids dropped; spaces were the special ones."""
    from quern.functions.text import characters

    b = table(spark, sf, "benchmark").select("item_id", characters(F.col("text")).alias("c"))
    vocabulary = b.select(F.explode("c").alias("token")).distinct().select("token", F.xxhash64("token").alias("id"))
    ids = b.select("item_id", F.transform("c", lambda c: F.xxhash64(c)).alias("ids"))
    places = ids.select("item_id", F.posexplode("ids").alias("pos", "id")).join(vocabulary, "id").filter("token <> ' '")
    lists = places.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))
    return lists.select("item_id", F.array_join(F.transform("x", lambda s: s["token"]), "").alias("text"))


@query("""WITH b AS (SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) // 8 AS batch, list_transform(string_split(text, ''), lambda c: (unicode(c) % 500 + 12)::INT) AS ids FROM benchmark),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS n FROM b)
SELECT item_id, batch, array_to_string(list_concat(ids, list_transform(range(n - len(ids)), lambda i: 0::INT)), ',') AS input_ids, array_to_string(list_transform(range(n), lambda i: (i < len(ids))::INT), ',') AS attention_mask FROM m""")
def tk_batch(spark, sf):
    """Padded batches of eight with their attention masks."""
    from quern.operators import training

    codes = F.transform(text.characters(F.col("text")), lambda c: (F.ascii(c) % 500 + 12).cast("int"))
    rows = training.batches(table(spark, sf, "benchmark").select("item_id", codes.alias("ids")), "item_id", 8)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rows.select("item_id", "batch", listed("input_ids"), listed("attention_mask"))


def _queues(spark, sf):
    return events(spark, sf).select((F.col("user_id") % 10).alias("key"), F.col("event_id").alias("id"), text.millis(F.col("ts")).alias("ts_ms"))


@query()
def st_batches(spark, sf):
    """Batches of each queue: dispatched at 16 requests or after 20 ms."""
    return usage.micro_batches(_queues(spark, sf))


@query()
def a_batcher(spark, sf):
    return usage.batcher_stats(usage.micro_batches(_queues(spark, sf)))


_stored = folder


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def src_jsonl(spark, sf):
    """Compressed JSON lines, written and read again."""
    path = _stored(spark, "jsonl")
    table(spark, sf, "documents").select("doc_id", "text").filter("text is not null").write.option("compression", "gzip").json(path)
    return files.read_jsonl(spark, path, "doc_id long, text string")


@query("SELECT l AS line, count(*) AS n FROM (SELECT trim(unnest(string_split(text, chr(10))), ' ' || chr(9)) AS l FROM benchmark) WHERE l <> '' GROUP BY 1")
def src_lines(spark, sf):
    path = _stored(spark, "lines")
    table(spark, sf, "benchmark").select("text").write.text(path)
    return files.read_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT url FROM pages WHERE url NOT LIKE '#%' AND trim(url) <> ''")
def src_url_list(spark, sf):
    path = _stored(spark, "urls")
    listed = table(spark, sf, "pages").select(F.explode(F.array("url", F.concat(F.lit("# "), "url"), F.lit(""))).alias("value"))
    listed.write.text(path)
    return files.read_url_list(spark, path)


@query("SELECT conv_id, turn, text FROM conversations WHERE length(text) > 0")
def src_ingest_jsonl(spark, sf):
    """Records that are numbered by their lines, each line once."""
    path = _stored(spark, "numbered")
    table(spark, sf, "conversations").select("conv_id", "turn", "text").filter("length(text) > 0").write.json(path)
    rows = files.read_numbered(spark, path, "conv_id long, turn long, text string")
    return rows.dropDuplicates(["source"]).select("conv_id", "turn", "text")


@query("SELECT count(*) AS lines FROM pages")
def src_count_lines(spark, sf):
    path = _stored(spark, "counted")
    table(spark, sf, "pages").select(F.to_json(F.struct("page_id", "url")).alias("value")).write.text(path)
    return spark.range(1).select(F.lit(files.count_lines(spark, path)).cast("long").alias("lines"))


@query("SELECT split, count(*) AS docs FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY 1")
def snk_splits(spark, sf):
    """A folder for each split, read back, and its card."""
    d = table(spark, sf, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train"))
    return files.write_splits(d, _stored(spark, "splits"))


@query(r"WITH h AS (SELECT doc_id, md5(trim(regexp_replace(lower(nfc_normalize(text)), '\s+', ' ', 'g'))) AS h, length(trim(text)) > 0 AS ok FROM documents) SELECT min(doc_id) AS doc_id FROM h WHERE ok AND doc_id % 2 = 1 AND h NOT IN (SELECT h FROM h WHERE ok AND doc_id % 2 = 0) GROUP BY h")
def snk_hashset(spark, sf):
    """Hashes that one run stores keep another run's documents out."""
    path, d = _stored(spark, "seen"), table(spark, sf, "documents")
    dedup.remember(d.filter("doc_id % 2 = 0"), path)
    return dedup.unseen(d.filter("doc_id % 2 = 1"), spark.read.parquet(path)).select("doc_id")


@query()
def snk_lsh(spark, sf):
    """Signatures that one run stores keep another run's near copies out."""
    path, d = _stored(spark, "signatures"), table(spark, sf, "documents")
    dedup.remember_signatures(d.filter("doc_id % 2 = 0"), path)
    return dedup.near_unseen(d.filter("doc_id % 2 = 1"), spark.read.parquet(path)).select("doc_id")


@query()
def tk_load(spark, sf):
    """A tokenizer that was trained on documents, saved and loaded, over the benchmark."""
    from quern.operators import tokenizers

    merges, vocabulary = tokenizers.train_bpe(tokenizers.word_counts(table(spark, sf, "documents"), tokenizers.pretokens(F.col("text"))), 1_000)
    folder = _stored(spark, "tokenizer")
    tokenizers.Tokenizer(vocabulary, merges).save(spark, folder)
    return tokenizers.load(spark, folder).encode(table(spark, sf, "benchmark"), key="item_id")
