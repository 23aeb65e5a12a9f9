"""Streams that stop and start again, sinks that replay, and batches by number or time."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.sources import lines, webhooks
from quern.streaming import batching


def put(path, texts, mode="w", end="\n"):
    with open(path, mode, encoding="utf-8") as f:
        f.write("\n".join(json.dumps({"text": t}) if isinstance(t, str) else json.dumps(t) for t in texts) + end)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_every_line_belongs_to_one_range(tmp_path, size):
    from pyarrow import fs

    path = str(tmp_path / "x.jsonl")
    rng = np.random.default_rng(size)
    want = [bytes(rng.integers(97, 123, int(rng.integers(0, 30))).astype(np.uint8)) for _ in range(50)]
    for end in (b"", b"\n"):
        (tmp_path / "x.jsonl").write_bytes(b"\n".join(want) + b"x" + end)
        n = (tmp_path / "x.jsonl").stat().st_size
        got = [line for a in range(0, n, size) for _, line in lines.lines_of(fs.LocalFileSystem(), path, a, min(n, a + size))]
        assert got == [*want[:-1], want[-1] + b"x"]


def run(spark, source, out, checkpoint, **options):
    stream = spark.readStream.format("json_lines").options(path=str(source), **options).load()
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out))
    assert q.awaitTermination(120)
    return [r["text"] for r in spark.read.parquet(str(out)).collect()]


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    lines.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "a.jsonl", [f"a{i} é" for i in range(40)] + [{"other": 1}, {"text": ""}, {"text": 5}, [1]])
    put(folder / "b.jsonl", [f"b{i}" for i in range(40)])
    (folder / "note.txt").write_text("no")
    first = run(spark, folder, tmp_path / "out", tmp_path / "cp", bytesPerTask="200")
    assert Counter(first) == Counter([f"a{i} é" for i in range(40)] + [f"b{i}" for i in range(40)])
    put(folder / "a.jsonl", [f"later{i}" for i in range(30)], "a")
    put(folder / "c.jsonl", ["{ not json" * 2, "c"])
    with open(folder / "c.jsonl", "a") as f:
        f.write("broken {\n")
    again = run(spark, folder, tmp_path / "out", tmp_path / "cp", bytesPerTask="200")
    assert Counter(again) == Counter(first) + Counter([f"later{i}" for i in range(30)] + ["{ not json" * 2, "c"])
    assert Counter(run(spark, folder, tmp_path / "out", tmp_path / "cp")) == Counter(again)
    batch = spark.read.format("json_lines").options(path=str(folder), bytesPerTask="100").load()
    assert Counter(r["text"] for r in batch.collect()) == Counter(again)


def test_lines_in_writing_wait(spark, tmp_path):
    lines.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "a.jsonl", ["one", "two"], end="")
    assert run(spark, folder, tmp_path / "out", tmp_path / "cp", growing="true") == ["one"]
    with open(folder / "a.jsonl", "a") as f:
        f.write("\n")
    put(folder / "a.jsonl", ["three"], "a")
    assert sorted(run(spark, folder, tmp_path / "out", tmp_path / "cp", growing="true")) == ["one", "three", "two"]


def test_examples_are_cut_and_padded(spark, tmp_path):
    lines.register(spark)
    put(tmp_path / "a.jsonl", ["abcdefgh", "ab"])
    df = spark.read.format("json_lines").option("path", str(tmp_path / "a.jsonl")).load()
    codes = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x))
    got = {r["place"]: r for r in lines.examples(df, codes, 4).collect()}
    assert [len(r["input_ids"]) for r in got.values()] == [4, 4]
    short = max(got.items())[1]
    assert short["input_ids"] == [97, 98, 0, 0] and short["attention_mask"] == [1, 1, 0, 0] and short["labels"] == [97, 98, -100, -100]


@pytest.fixture
def server():
    got, fail = [], {"times": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            status = 200
            if fail["times"] > 0:
                fail["times"] -= 1
                status = 503
            else:
                got.append((self.headers[webhooks.DELIVERY], self.headers[webhooks.SIGNATURE], self.headers[webhooks.EVENT], body))
            self.send_response(status)
            self.end_headers()

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/hook", got, fail
    s.shutdown()


def test_deliveries_are_signed_and_tried_again(spark, server, tmp_path):
    url, got, fail = server
    webhooks.register(spark)
    fail["times"] = 2
    df = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "id long, name string").repartition(2)
    df.write.format("webhook").options(url=url, secret="s", event="made", tries="3", pause="0.01", log=str(tmp_path / "log")).mode("append").save()
    assert sorted(json.loads(b)["data"]["id"] for *_, b in got) == list(range(6))
    assert all(sig == webhooks.signature(b, "s") and sig != webhooks.signature(b, "t") and e == "made" for _, sig, e, b in got)
    [log] = [json.loads(p.read_text()) for p in (tmp_path / "log").iterdir()]
    assert log["rows"] == 6 and log["tries"] == 8
    fail["times"] = 100
    with pytest.raises(Exception, match="failed after 2 tries"):
        df.limit(1).write.format("webhook").options(url=url, tries="2", pause="0.01").mode("append").save()


def test_a_replayed_batch_takes_effect_once(spark, server, tmp_path):
    url, got, _ = server
    webhooks.register(spark)
    lines.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "a.jsonl", [f"t{i}" for i in range(10)])

    def once():
        stream = spark.readStream.format("json_lines").option("path", str(folder)).load().select("place", "text")
        q = stream.writeStream.format("webhook").options(url=url, secret="s", log=str(tmp_path / "log")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    once()
    (tmp_path / "cp" / "commits" / "0").unlink()  # as if the query had stopped before it noted the batch
    for crc in (tmp_path / "cp" / "commits").glob(".0.crc"):
        crc.unlink()
    once()
    assert len(got) == 20 and len({d for d, *_ in got}) == 10
    assert {p.name for p in (tmp_path / "log").iterdir()} == {"batch-0.json"}


def plain_batches(rows, most, wait):
    out = []
    for key in sorted({k for k, *_ in rows}):
        held = []
        n = 0
        for _, i, t in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if held and t >= held[0][1] + wait:
                out.append((key, n, [x for x, _ in held], held[0][1], held[0][1] + wait, False))
                n, held = n + 1, []
            held.append((i, t))
            if len(held) == most:
                out.append((key, n, [x for x, _ in held], held[0][1], t, True))
                n, held = n + 1, []
        if held:
            out.append((key, n, [x for x, _ in held], held[0][1], held[0][1] + wait, False))
    return out


def test_batches_by_number_or_timer(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(k), i, int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 120), np.sort(rng.integers(0, 700, 120)), strict=True))]
    folder = tmp_path / "in"
    late = [(9, 10_000, 50_000)]  # moves the watermark past all timers
    for n, part in enumerate((rows[:50], rows[50:], late)):
        spark.createDataFrame(part, "key long, id long, ts_ms long").coalesce(1).write.mode("append").parquet(str(folder / f"p{n}"))

    def go():
        stream = spark.readStream.schema("key long, id long, ts_ms long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(folder))
        q = batching.batched(stream, 5, 20).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(300)

    go()
    got = sorted((r["key"], r["batch"], list(r["ids"]), r["first_ms"], r["dispatched_ms"], r["full"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [g for g in got if g[0] != 9] == sorted(plain_batches(rows, 5, 20))
    assert any(g[-1] for g in got) and not all(g[-1] for g in got)
