import bz2
import gzip
import json
import time

from pyspark.sql import functions as F

from quern.plans import corpus_build
from quern.sources import files
from quern.sources.crawl import crawl
from quern.streaming import limits

WORDS = " ".join(f"Sentence number {i} says something new about topic{i} and thing{i % 7}." for i in range(12))


def test_jsonl_skips_bad_lines_and_reads_gz(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x"}\nnot json\n\n{"text": "y"}\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"text": "z"}\n')
    assert sorted(r["text"] for r in files.read_jsonl(spark, str(tmp_path)).collect()) == ["x", "y", "z"]


def test_checked_lines(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"text": "ok"}\n{"text": 5}\n{"other": 1}\n{bad\n')
    got = {r["value"]: (r["parses"], r["has_text"], r["text"]) for r in files.read_jsonl_checked(spark, str(p)).collect()}
    assert got == {'{"text": "ok"}': (True, True, "ok"), '{"text": 5}': (True, False, None), '{"other": 1}': (True, False, None), "{bad": (False, False, None)}


def test_documents_and_url_lists(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "1.txt").write_text(" one\x00 \n")
    (tmp_path / "d" / "e" / "2.txt").write_text("two\nlines")
    assert sorted(r["text"] for r in files.read_documents(spark, str(tmp_path / "d")).collect()) == ["one", "two\nlines"]
    (tmp_path / "u").write_text("# no\nhttp://a\n\n http://b \n")
    assert [r["url"] for r in files.read_url_list(spark, str(tmp_path / "u")).collect()] == ["http://a", "http://b"]


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text('{"text": "a"}\n\n{"text": "b"}\n')
    assert sorted((r["text"], r["source"]) for r in files.read_numbered(spark, str(tmp_path / "n.jsonl")).collect()) == [("a", "n.jsonl:L1"), ("b", "n.jsonl:L3")]


def test_wiki_dump(spark, tmp_path):
    long = "'''Bold''' [[Link|shown]] {{gone}} == Head == " + "text " * 60
    xml = f"<mediawiki><page><title>T</title><revision><text>{long}</text></revision></page><page><title>R</title><redirect title='T'/><revision><text>#REDIRECT [[T]]</text></revision></page><page><title>S</title><revision><text>short</text></revision></page></mediawiki>"
    (tmp_path / "w.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    rows = files.read_wiki_dump(spark, str(tmp_path / "w.xml.bz2")).collect()
    assert [r["title"] for r in rows] == ["T"] and rows[0]["text"].startswith("Bold shown")


def test_sinks(spark, tmp_path):
    df = spark.range(10).select(F.col("id"), F.when(F.col("id") < 7, "train").otherwise("val").alias("split"))
    files.write_jsonl(df.coalesce(1), str(tmp_path / "j"), chunk=4)
    assert len(list((tmp_path / "j").glob("part-*"))) == 3
    files.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "split=val")).count() == 3


def test_registry(spark, tmp_path):
    def version(folder, meta, *names):
        (tmp_path / "m" / folder / "tokenizer").mkdir(parents=True)
        (tmp_path / "m" / folder / "metadata.json").write_text(meta)
        for n in names:
            (tmp_path / "m" / folder / n).write_text("x")

    whole = ("model.pt", "config.json", "tokenizer/vocab.json")
    version("9", '{"version": "9", "promoted_at": "2024-01-01"}', *whole)
    version("10", '{"version": "10", "promoted_at": "2024-02-01"}', *whole)
    version("11", '{"version": "11", "promoted_at": "2024-01-15"}', "model.pt", "config.json")
    version("latest", '{"version": "10"}', *whole)
    got = [(r["version"], r["complete"], r["latest"]) for r in files.registry(spark, str(tmp_path)).collect()]
    assert got == [("10", True, True), ("11", False, False), ("9", True, False)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"text": "t{i}"}}\n' + "\n" * (i % 3 == 0) for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    got = {r["source"]: r["text"] for r in files.read_numbered(spark, str(tmp_path / "a.jsonl")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want, n = {}, 1
    for i in range(4000):
        want[f"a.jsonl:L{n}"] = f"t{i}"
        n += 1 + (i % 3 == 0)
    assert got == want


def test_addresses_as_a_source(spark, tmp_path):
    from quern.sources import urls

    (tmp_path / "p.html").write_text("<html><body><b>plain</b> words</body></html>")
    urls.register(spark)
    listed = f"file://{tmp_path}/p.html\n# no\nfile://{tmp_path}/gone.html"
    got = {r["url"][-6:]: (r["text"], r["error"] is None) for r in spark.read.format("urls").option("urls", listed).load().collect()}
    assert got == {"p.html": ("plain words", True), "e.html": (None, False)}


def test_quota_stream(spark, tmp_path):
    from quern.streaming import limits

    rows = [(1, "d", 1, 60), (1, "d", 2, 60), (1, "d", 3, 60), (2, "d", 4, 500), (2, "e", 5, 1)]
    spark.createDataFrame(rows, "org_id long, day string, id long, tokens long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("org_id long, day string, id long, tokens long").parquet(str(tmp_path / "in"))
    limits.quota(stream, 100).writeStream.format("memory").queryName("quotas").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r["id"]: r["allowed"] for r in spark.table("quotas").collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_a_running_stream_forgets_idle_keys(spark, tmp_path):
    from quern.streaming import limits

    schema = "key long, id long, ts_ms long"
    spark.createDataFrame([(1, 1, 0), (1, 2, 1)], schema).write.parquet(str(tmp_path / "in"))
    out = limits.limited(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 1, 10, idle_ms=1_500)
    q = out.writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline:
            time.sleep(0.5)
            rows = [p["stateOperators"][0]["numRowsTotal"] for p in (x if isinstance(x, dict) else json.loads(x.json) for x in q.recentProgress) if p["stateOperators"]]
            if 1 in rows and rows[-1] == 0:
                break
        assert 1 in rows and rows[-1] == 0
    finally:
        q.stop()
    assert {r["id"]: r["allowed"] for r in spark.table("limits").collect()} == {1: True, 2: False}


def test_event_log(spark, tmp_path):
    from quern.streaming import limits

    spark.range(5).write.parquet(str(tmp_path / "in"))
    q = limits.event_log(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(str(tmp_path / "log")).count() == 5


def page(i, *links):
    return f"<html><head><title>P{i}</title></head><body><main><p>{WORDS}</p>{''.join(f'<a href={x}>l</a>' for x in links)}</main></body></html>"


def test_crawl_depth_and_domains(spark):
    pages = spark.createDataFrame([("http://a/1", page(1, "/2", "http://b/1")), ("http://a/2", page(2, "/3", "/1")), ("http://a/3", page(3)), ("http://b/1", page(4))], "url string, html string")
    seeds = spark.createDataFrame([("http://a/1#x",)], "url string")
    assert {(r["url"], r["depth"]) for r in crawl(pages, seeds, max_depth=1).collect()} == {("http://a/1", 0), ("http://a/2", 1)}


def test_two_equal_pages_make_one_document(spark, tmp_path):
    pages = spark.createDataFrame([("http://a/1", page(1)), ("http://b/1", page(1))], "url string, html string")
    for force in (False, True):
        tables = corpus_build.build(pages, str(tmp_path / "c"), force=force)
        assert [tables[s].count() for s in corpus_build.STAGES] == [2, 1, 1, 1]
    assert json.loads(corpus_build.stats(tables).toJSON().first())["exact_rate"] == 0.5


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, i * 1000) for i in range(40) for k in (1, 2)], "key long, id long, ts_ms long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = limits.limited(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 5, 10_000).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    from quern.operators.usage import replay_limit

    got = {(r["key"], r["id"]): r["allowed"] for r in spark.sql("SELECT * FROM limited").collect()}
    want = {(r["key"], r["id"]): r["allowed"] for r in replay_limit(rows, 5, 10_000).collect()}
    assert got == want and not all(got.values())


def test_window_stream_and_sink(spark, tmp_path):
    from quern.operators.usage import usage_view

    ev = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 00:00:0{i % 10}", i % 4, "view", float(i)) for i in range(30)], "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = limits.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == 30
    q = usage_view(stream).writeStream.foreachBatch(limits.usage_sink(str(tmp_path / "r"), str(tmp_path / "t"))).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "r")).count() == 30
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.sum("requests")).first()[0] == 30


def test_shuffle_buffer_keeps_rows(spark):
    d = spark.range(1000).coalesce(1)
    got = [r["id"] for r in limits.shuffled(d, 100).collect()]
    assert sorted(got) == list(range(1000)) and got != list(range(1000))
