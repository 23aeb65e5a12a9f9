"""Operators that SQL can't express against plain versions of their rules, long texts, clashing names and odd pipelines."""

import hashlib
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import common, fingerprints, language_id, line_dedup, mixing, near_dedup, packing, pretoken, quality, token_counts, topk, url_filters
from quern.llm.queries import tokenizer_path
from test_llm import odd_rows, plain_components, prose, table

# 1


def plain_fingerprint(text, gram=fingerprints.GRAM, window=fingerprints.WINDOW):
    """Chosen hashes by the definition: of each window the least hash, the rightmost of equal ones."""
    if len(text) < gram:
        return set(fingerprints.winnow(text)[0].tolist())
    grams = [int(fingerprints.winnow(text[i : i + gram], gram, 1)[0][0]) for i in range(len(text) - gram + 1)]
    out = set()
    for i in range(max(1, len(grams) - window + 1)):
        out.add(min(grams[i : i + window]))
    return out


def test_likeness_against_plain_fingerprints(spark):
    rng = np.random.default_rng(41)
    texts = [prose(rng, int(n)) for n in rng.integers(0, 25, 14)] + ["", "short", "ünïcode 😀 " * 9]
    rows = [(i, t, None, "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprints.compared(table(spark, rows).repartition(3)).collect()}
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    hexed = lambda text: "".join(f"{h:08x}" for h in fingerprints.winnow(text)[0].tolist())
    for i, t in enumerate(texts):
        nxt = texts[i - 1]  # descending ids; after the last the first
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (hexed(t), hexed(edited))
        assert r["near_edited"] == pytest.approx(like(plain_fingerprint(t), plain_fingerprint(edited)))
        assert r["near_next"] == pytest.approx(like(plain_fingerprint(t), plain_fingerprint(nxt)))


def test_one_id_for_most_rows_is_dealt_over_blocks(spark):
    rng = np.random.default_rng(42)
    rows = [(None if i % 3 else 5, prose(rng, 12), None, "s") for i in range(300)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    ordered = fingerprints.in_order(table(spark, rows).repartition(4))
    sizes = [r["count"] for r in ordered.filter("not guest").groupBy("block").count().collect()]
    n = fingerprints.compared(table(spark, rows).repartition(4)).count()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert n == 300 and len(sizes) > 3 and max(sizes) < 150


# 3


def test_decoding_against_the_definition():
    rng = np.random.default_rng(43)
    counts = {name: rng.integers(1, 200, 64).astype(float) for name in ("a", "b", "c", "d", "e")}
    m = language_id.Model(counts)
    texts = rng.integers(0, 9, (40, 64))
    best, score, close = m.decode(texts)
    for k, text in enumerate(texts):
        losses = []
        for code in m.codes:
            loss = 0.0
            for bit in range(len(code)):
                out = sum(n * w for n, w in zip(text, m.weights[:, bit], strict=True)) / max(1, text.sum())
                loss += m.bit_weights[bit] * np.log1p(np.exp(-out * code[bit]))
            losses.append(loss)
        low = sorted(losses)
        assert losses[best[k]] == pytest.approx(low[0], rel=1e-3)
        if abs(low[1] - low[0] - language_id.CLOSE) > 1e-3:
            assert close[k] == (low[1] - low[0] < language_id.CLOSE)


def test_a_text_between_two_languages_is_ambiguous(spark):
    rng = np.random.default_rng(44)
    kinds = {"xx": ["ka", "ko", "mi", "to"], "yy": ["be", "sc", "un", "ei"]}
    word = lambda k: "".join(rng.choice(kinds[k], 3))
    train = table(spark, [(i, " ".join(word(k) for _ in range(30)), k, "s") for i, k in enumerate(["xx", "yy"] * 60)])
    texts = [" ".join(word("xx") for _ in range(40)), " ".join(word("xx" if i % 2 else "yy") for i in range(60))]
    got = {r["doc_id"]: r["ambiguous"] for r in language_id.predict(table(spark, [(i, t, None, "s") for i, t in enumerate(texts)]), language_id.train(train)).collect()}
    assert got == {0: False, 1: True}


# 7


def plain_lines(rows, min_docs=8, min_tokens=3, long_tokens=50):
    """The numbers of dropped lines of each row, line by line, template by template and run by run. Rows of one id are told
    apart by their texts; ``order`` is any order of texts."""
    star = object()
    found, exact, runs = defaultdict(list), defaultdict(set), defaultdict(set)
    texts = []
    for r, (i, t, *_) in enumerate(rows):
        for n, line in enumerate((t or "").split("\n")):
            tokens = ["#" if any(c.isdigit() for c in w) else w.lower() for w in line.split()]
            m = len(tokens)
            if not m:
                continue
            exact[tuple(tokens)].add(r)
            texts.append((r, n, tuple(tokens)))
            if m < min_tokens:
                continue
            forms = [(m, tuple(tokens))]
            if m >= 8:
                cuts = [m * k // 4 for k in range(5)]
                # Leading tokens are the tree's: they stand even where they are part of what varies.
                forms += [(m, tuple(tokens[:2]), tuple(star if cuts[f] <= k < cuts[f + 1] else w for k, w in enumerate(tokens)), f) for f in range(4)]
            for form in forms:
                found[form].append((r, n))
    for r in range(len(rows)):  # runs of two or more adjacent lines that all recur
        own = [(n, w) for q, n, w in texts if q == r]
        for a in range(len(own)):
            size = 0
            for b in range(a, len(own)):
                if len(exact[own[b][1]]) < 2:
                    break
                size += len(own[b][1])
                if b > a and size >= long_tokens:
                    runs[tuple(w for _, w in own[a : b + 1])].add((r, tuple(n for n, _ in own[a : b + 1])))
    key = lambda r: (rows[r][0] is not None, rows[r][0] or 0, plain_lines.order(rows[r][1]))
    drop = defaultdict(set)
    for form, places in found.items():
        least = 2 if form[0] >= long_tokens and len(form) == 2 else min_docs
        docs = {r for r, _ in places}
        first = min(map(key, docs))
        if len(docs) >= least:
            for r, n in places:
                if key(r) != first:
                    drop[r].add(n)
    for places in runs.values():
        first = min(key(r) for r, _ in places)
        if len({r for r, _ in places}) > 1:
            for r, lines in places:
                if key(r) != first:
                    drop[r].update(lines)
    return drop


@pytest.mark.parametrize("ids", [lambda i: i, lambda i: None, lambda i: i // 7, lambda i: None if i % 3 else i])
def test_templates_against_plain_ones(spark, ids):
    rng = np.random.default_rng(45)
    bases = [prose(rng, n) for n in (4, 8, 9, 14, 55)]
    run = [prose(rng, n) for n in (20, 2, 21, 1, 19)]
    rows = []
    for i in range(40):
        lines = [prose(rng, int(rng.integers(3, 12)))]
        for b in bases:
            if rng.random() < 0.5:
                w = b.split()
                for k in rng.choice(len(w), int(rng.integers(0, 3)), replace=False):
                    w[k] = str(rng.choice(["new", "7x", "other", "12"]))
                lines.append(" ".join(w))
        lines = rng.permutation(lines).tolist()
        if i % 9 == 4:
            lines[1:1] = run[: int(rng.integers(2, 6))]
        rows.append((ids(i), "\n".join(lines), None, "s"))
    rows.append(rows[5])  # a repeated row
    docs = table(spark, rows).repartition(4)
    order = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    plain_lines.order = order.get
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.drop_lines(docs, long_tokens=55).collect())
    drop = plain_lines(rows, long_tokens=55)
    want = Counter((i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop[r])) for r, (i, t, *_) in enumerate(rows))
    assert got == want
    assert sum(map(len, drop.values())) > 20


def test_footers_of_documents_without_ids(spark):
    rng = np.random.default_rng(47)
    rows = [(None, f"{prose(rng, 9)}\nall rights are reserved here", None, "s") for _ in range(20)]
    got = [r["text"] for r in line_dedup.drop_lines(table(spark, rows)).collect()]
    assert sum("reserved" in t for t in got) == 1 and len(got) == 20


def test_many_lines_take_time_in_proportion(spark):
    import time

    half = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)} recurs in two documents or more than that of them " * 5 for i in range(40_000)]
    own = [f"line of the first {i} {i * 7}" for i in range(40_000)]
    mixed = "\n".join(x for pair in zip(half, own, strict=True) for x in pair)
    docs = table(spark, [(1, "\n".join(half), None, "s"), (2, mixed, None, "s")])
    began = time.time()
    got = {r["doc_id"]: (r["__q_lines"], r["__q_dropped"], len(r["text"])) for r in line_dedup.drop_lines(docs).collect()}
    assert len(mixed) > 10_000_000 and time.time() - began < 90
    assert got[1][1] == 0 and got[2][:2] == (80_000, 40_000) and got[2][2] == len("\n".join(own))


def test_rows_without_ids_draw_on_their_own(spark):
    from pyspark.sql import functions as F

    docs = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.concat(F.lit("text number "), F.format_string("%05d", "id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    for seed in (17, 18, 19):
        out = mixing.mix(docs, targets={"s": 1.0}, seed=seed)
        copies = Counter(r["n"] for r in out.groupBy("text").agg(F.count("*").alias("n")).collect())
        assert abs(sum(n * k for n, k in copies.items()) - 2000) < 150 and 600 < copies[1] < 880  # 2000 / e
        assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 900 or out.rdd.getNumPartitions() < 3


def test_long_lines_that_differ_in_a_quarter_are_text(spark):
    rng = np.random.default_rng(46)
    w = prose(rng, 60).split()
    other = " ".join(w[:45] + prose(rng, 15).split())
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(table(spark, [(1, " ".join(w), None, "s"), (2, other, None, "s"), (3, other, None, "s")])).collect()}
    assert got == {1: " ".join(w), 2: other, 3: ""}


# 8


def test_rounds_teach_each_view_what_the_other_knows(spark):
    # Pages of one source are bad, but no labelled page is from the sources of the pool's bad ones: only their texts tell.
    rng = np.random.default_rng(47)
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        text = " ".join(["spam", "click", "now"] * 5 + prose(rng, 20).split()) if bad else prose(rng, 35)
        known = i < 500
        rows.append((i, text, "en", ("bad" if bad else "good") + ("1" if known else "2")))
        if known:
            labels.append((i, int(not bad), 0))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = table(spark, rows)
    model = quality.train(d, lab)
    got = quality.scored(d.select("doc_id", "text", "source", "lang"), model).collect()
    meta = {r["doc_id"]: r[quality.SCORES[1]] for r in got}
    assert np.mean([meta[i] < 0.5 for i in range(501, 900, 3)]) > 0.9  # learnt from the text view's labels
    assert np.mean([(r[quality.SCORES[2]] >= 0.5) == (r["doc_id"] % 3 != 0) for r in got]) > 0.97


def test_words_are_chosen_by_the_g_statistic(spark):
    rng = np.random.default_rng(48)
    rows = [(f"{prose(rng, 10)} {'mark' if i % 2 else 'plain'}", i % 2) for i in range(200)]
    chosen = quality._chosen(spark.createDataFrame(rows, "text string, good int"))
    hashes = lambda t: set(next(quality.text_view(pa.array([t])))[4].tolist())
    assert hashes("mark plain") <= set(chosen.tolist())


# Long texts


@pytest.fixture(scope="module")
def long_text():
    rng = np.random.default_rng(49)
    return "\n".join(prose(rng, 40) + "." for _ in range(30_000))  # 6 MB


def test_long_texts_take_bounded_memory(long_text):
    column = pa.array([long_text])
    raw, offsets = common.buffer_of(column)
    steps = {
        "winnow": lambda: fingerprints.winnow(long_text),
        "pretokens": lambda: pretoken.pretokens(column),
        "grams": lambda: language_id.gram_counts(raw, offsets),
        "lines": lambda: line_dedup.templates(raw, offsets),
        "views": lambda: list(quality.text_view(column)),
        "shingles": lambda: list(near_dedup.shingle_sets(column)),
    }
    for name, step in steps.items():
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20 * len(raw), name


def test_parts_of_long_texts_make_no_difference(monkeypatch, long_text):
    text = long_text[:300_000] + "x" * 70_000 + " é " + long_text[300_000:310_000]
    column = pa.array([text, None, "short", text[:5_000]])
    raw, offsets = common.buffer_of(common.strings(column))
    tokens = lambda: [x.as_py() for x in pretoken.pretokens(column)[0]]
    results = []
    for step in (1 << 19, 1 << 12):
        for module in (common, language_id):
            monkeypatch.setattr(module, "SLICE_BYTES", step)
        monkeypatch.setattr(fingerprints, "STEP", step)
        segments = pretoken.segments
        monkeypatch.setattr(pretoken, "segments", lambda a, b, s=step, f=segments: f(a, b, s))
        results.append((tokens(), pretoken.pretokens(column)[1].tolist(), fingerprints.winnow(text)[1].tolist(), language_id.gram_counts(raw, offsets).tolist(), [s.tolist() for s in near_dedup.shingle_sets(column)], line_dedup.templates(raw, offsets)[3].tolist()))
        monkeypatch.setattr(pretoken, "segments", segments)
    assert results[0] == results[1]


def test_operators_on_a_long_text(spark, long_text):
    from tokenizers import Tokenizer

    text = long_text[:2_500_000]
    rows = [(1, text, "en", "s"), (2, text + " end", "en", "s"), (3, "short", "en", "s")]
    d = table(spark, rows)
    n = len(Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(d, tokenizer_path()).collect()}[1] == n
    assert {(r["doc_id"], r["doc_tokens"]) for r in packing.pack(d.filter("doc_id <> 2"), tokenizer_path()).collect()} == {(1, n + 1), (3, 2)}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(d).collect()} == {1: 1, 2: 1, 3: 3}
    assert fingerprints.compared(d).count() == line_dedup.drop_lines(d).count() == 3


# 5, 6 and 10


def test_extra_columns_and_empty_vectors(spark):
    e = spark.createDataFrame([(i, [float(i), 1.0], 3, "c") for i in range(60)], "vec_id long, embedding array<float>, rank int, score string")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in topk.top_k(e).collect()}
    assert got[50, 1] == 59 and len(got) == 10
    assert topk.top_k(e.limit(0)).count() == 0


def test_copies_are_named_apart(spark, tmp_path):
    d = table(spark, [(i, "text", None, "s") for i in range(20)]).withColumnRenamed("kept", "Copy").withColumnRenamed("value", "rate")
    out = mixing.mix(d)
    assert out.columns == [*d.columns, "copy_"]
    out.write.parquet(str(tmp_path / "out"))


def test_many_sources_are_joined_by_shuffle(spark, monkeypatch):
    rows = [(i, "text " * (1 + i % 7), None, f"s{i % 50}" if i % 3 else "hot") for i in range(600)] + [(999, "x", None, None)]
    d = table(spark, rows)
    want = Counter((r["doc_id"], r["copy"]) for r in mixing.mix(d).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert Counter((r["doc_id"], r["copy"]) for r in mixing.mix(d).collect()) == want


def test_registered_domains(spark):
    want = {"a.example.co.uk": ("example.co.uk", "co.uk"), "x.com": ("x.com", "com"), "10.0.0.1": ("10.0.0.1", ""), "[::1]": ("[::1]", ""), "localhost": ("localhost", "localhost"), "co.uk": ("co.uk", "co.uk")}
    from pyspark.sql import functions as F

    unit = url_filters.unit_of(F.col("h"))
    rows = [(h, h) for h in want] + [("x.com:8080", "x.com"), ("u:p@x.com.", "x.com"), ("[::1]:80", "[::1]"), ("", "")]
    got = spark.createDataFrame(rows, "h string, u string").select("u", unit.alias("unit"), url_filters.domain_of(unit).alias("d"), url_filters.suffix_of(unit).alias("s")).collect()
    assert all(r["u"] == r["unit"] and (r["d"], r["s"]) == want.get(r["u"], ("", "")) for r in got)


def test_no_pages_and_very_long_urls(spark):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "http://h.net/" + "p" * 1_000_000), (None, None)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], len(r["path"]), r["verdict"]) for r in url_filters.judge(pages, labels).collect()}
    assert got == {1: ("h.net", 1_000_001, "block"), None: ("", 0, "allow")}
    assert url_filters.judge(pages.limit(0), labels).count() == 0


# The pipeline


def test_pipeline_on_odd_rows_and_none(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    for name, rows in (("odd", odd_rows()), ("none", [])):
        folder = str(tmp_path / name)
        table(spark, rows).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        kept = {}
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, folder)
            if k < 4:
                assert out.columns == docs.columns
            out.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            kept[stage] = [tuple(r[:2]) for r in docs.select(docs.columns[0], docs.columns[1]).collect()]
        assert len(kept["quality"]) == len(rows)  # too few labels
        assert set(kept["line_dedup"]) >= {(i, t) for i, t, *_ in rows if not (t or "").strip()}  # nothing went from these
        # A component without any id is apart from others by its texts, which are unlike here.
        assert len(kept["near_dedup"]) == len({(c, n > 0, i if not n else 0) for i, n, c in plain_components(kept["line_dedup"])})
        assert bool(kept["packing"]) == bool(rows)
