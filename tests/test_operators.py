import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import corpus, dedup, evaluation, language, monitoring, quality, tokenizers, training, usage, vectors
from quern.sources.files import write_small


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_exact_keeps_the_first_of_each_content(spark):
    d = docs(spark, "Hello  World", "hello world", "", None, "other", "HELLO\nWORLD ")
    assert sorted(r["doc_id"] for r in dedup.exact(d).collect()) == [0, 4]
    s = dedup.exact_stats(d).first()
    assert (s["total"], s["unique_docs"], s["duplicates"], s["dup_rate"]) == (6, 2, 2, 0.3333)


def test_exact_is_idempotent_and_incremental(spark):
    d = docs(spark, "a b", "c d", "A  b")
    once = dedup.exact(d)
    assert dedup.exact(once.drop("content_hash")).count() == once.count() == 2
    assert dedup.unseen(d, once.select("content_hash")).count() == 0


def test_bands_of_the_default_threshold():
    assert dedup.bands_for(128, 0.85) == (9, 14)


def test_near_duplicates_against_a_sequential_replay(spark):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(8)]
    texts = []
    for b in base:
        texts += [b, b.replace("word1", "wird1", 1), " ".join(b.split()[:30]) + " end"]
    texts += ["abc", "xyz"]  # too short for a shingle: alike
    a, b = dedup.coefficients()
    bands, rows = dedup.bands_for()
    seen, kept = [], []
    for i, t in enumerate(texts):
        s = dedup.signature(dedup.shingle_hashes(t), a, b)
        like = lambda o, s=s: any((o[k * rows : (k + 1) * rows] == s[k * rows : (k + 1) * rows]).all() for k in range(bands)) and (o == s).mean() >= 0.85
        if not any(like(o) for o in seen):
            kept.append(i)
        seen.append(s)
    assert sorted(r["doc_id"] for r in dedup.near(docs(spark, *texts)).collect()) == kept


def test_rejection_codes_in_order(spark):
    prose = " ".join(f"word{i % 97} text{i % 89}" for i in range(60))
    d = docs(spark, "few words", prose, "1 2 3 4 " * 20, "one two three four five six seven eight nine ten " * 9, ". ".join(["the same sentence is here again"] * 4) + ". " + prose, "\n".join(f"item{i} of list{i}" for i in range(60)))
    got = [r["reason_code"] for r in quality.judged(d).orderBy("doc_id").collect()]
    assert got == ["too_short", None, "low_alpha_ratio", "high_ngram_repetition", "repeated_sentences", "high_bullet_ratio"]


def test_language_detection_learns_its_profiles(spark):
    en, de = "the quick brown fox jumps over the lazy dog and runs away " * 4, "der schnelle braune fuchs springt über den faulen hund und läuft " * 4
    train = spark.createDataFrame([(0, en, "en"), (1, de, "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.detect(docs(spark, en, de, "short"), language.profiles(train)).collect()}
    assert got == {0: "en", 1: "de", 2: "unknown"}


def test_gates_and_scan(spark):
    s = corpus.scan(docs(spark, "one two three", "", None, "nul\x00byte", "日本語の文章です" * 5))
    r = s.first()
    assert (r["total_docs"], r["missing_text"], r["empty_docs"], r["null_byte_docs"], r["non_ascii_docs"]) == (4, 1, 1, 1, 1)
    assert {g["name"]: g["passed"] for g in corpus.gates(s, min_docs=4, min_tokens=1, max_empty=1, max_non_ascii=0.5).collect()} == {"text_field": False, "no_null_bytes": False, "min_docs": True, "min_tokens": True, "near_empty_rate": True, "non_ascii_rate": True}


@pytest.mark.parametrize("partitions", [1, 5])
def test_split_is_complete_and_independent_of_partitions(spark, partitions):
    d = spark.range(101).select(F.col("id").alias("doc_id")).repartition(partitions)
    got = {r["split"]: r["count"] for r in corpus.split(d, 0.1, 0.1).groupBy("split").count().collect()}
    assert got == {"test": 11, "val": 11, "train": 79}
    assert corpus.split(d, 0.1, 0.1).filter("split = 'test'").agg(F.sum("doc_id")).first()[0] == corpus.split(d.coalesce(1), 0.1, 0.1).filter("split = 'test'").agg(F.sum("doc_id")).first()[0]


def test_limits(spark):
    import pandas as pd

    r = pd.DataFrame({"key": 1, "id": range(5), "ts_ms": [0, 10, 20, 60_000, 60_009]})
    # The rejected third request leaves no trace; at exactly 60 000 ms the first has left.
    assert usage.sliding_limit(r, 2, 60_000)["allowed"].tolist() == [True, True, False, True, False]


def test_empty_overview_is_zero(spark):
    e = spark.createDataFrame([], "total_tokens long, latency_ms double")
    assert tuple(usage.overview(e).first()) == (0, 0, 0)


def test_counter_resets(spark):
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 8, 2, 4])], "k string, s int, value double").select("k", F.timestamp_seconds("s").alias("ts"), "value")
    assert monitoring.increase(s, ["k"]).first()["increase"] == 7.0


def test_quantile_above_the_last_bound(spark):
    v = spark.createDataFrame([(1.0,), (500.0,)], "v double")
    assert monitoring.histogram_quantile(v, "v", 0.99, (1.0, 10.0)).first()["value"] == 10.0


def test_bpe_round_trip_and_merge_order(spark):
    d = docs(spark, "low low low lower lowest newest newest widest", "it's the newest 22")
    counts = tokenizers.word_counts(d, tokenizers.pretokens(F.col("text")))
    merges, vocabulary = tokenizers.train_bpe(counts, size=60, least=1)
    assert vocabulary[:12] == tokenizers.SPECIALS and len(set(vocabulary)) == len(vocabulary)
    ranks = {m: i for i, m in enumerate(merges)}
    ids = tokenizers.encode(d, tokenizers.pretokens(F.col("text")), lambda w: tokenizers.encode_bpe_word(w, ranks), vocabulary).orderBy("doc_id").collect()
    text = "".join(vocabulary[i] for i in ids[0]["ids"]).replace("Ġ", " ").lstrip()
    assert text == "low low low lower lowest newest newest widest"


def test_merge_does_not_overlap():
    assert tokenizers.merged(list("aaaa"), ("a", "a")) == ["aa", "aa"]
    assert tokenizers.merged(list("aaa"), ("a", "a")) == ["aa", "a"]


def test_wordpiece_longest_match():
    v = {"un", "##aff", "##able", "##a", "<unk>"}
    assert tokenizers.encode_wordpiece_word("unaffable", v) == ["un", "##aff", "##able"]
    assert tokenizers.encode_wordpiece_word("unx", v) == ["<unk>"] == tokenizers.encode_wordpiece_word("a" * 101, v)


def test_packing_conserves_tokens(spark):
    d = spark.createDataFrame([(i, list(range(12, 12 + n))) for i, n in enumerate([8, 7, 9, 0, 30])], "doc_id long, ids array<int>")
    blocks = training.pack(d, 8).orderBy("block_id").collect()
    flat = [t for n in [8, 7, 9, 0, 30] for t in [*range(12, 12 + n), 3]]
    assert [t for b in blocks for t in b["input_ids"]] == flat[: len(flat) // 8 * 8]


def test_masking(spark):
    d = spark.createDataFrame([(1, list(range(12, 112))), (2, [13])], "doc_id long, ids array<int>")
    for r in training.masked(d, 500).collect():
        ids = list(range(12, 112)) if r["doc_id"] == 1 else [13]
        chosen = [i for i, x in enumerate(r["labels"]) if x != -100]
        assert len(chosen) == max(1, int(len(ids) * 0.15))
        assert all(r["labels"][i] == ids[i] for i in chosen)
        assert all(r["input_ids"][i] == ids[i] for i in range(len(ids)) if i not in chosen)


def test_chat_and_mask(spark):
    t = spark.createDataFrame([(1, 1, "assistant", "yes"), (1, 0, "user", "ok?"), (1, 2, "tool", "x")], "conv_id long, turn long, role string, text string")
    assert training.chat_text(t, "S").first()["text"] == "<|system|>\nS\n<|user|>\nok?\n<|assistant|>\nyes\n<|end_turn|>\n<eos>"
    m = spark.createDataFrame([([8, 50, 10, 60, 61, 11, 70],)], "ids array<int>").select(training.response_mask(F.col("ids"), 10, 11).alias("m"))
    assert m.first()["m"] == [False, False, False, True, True, False, False]


def test_budgets(spark):
    t = spark.createDataFrame([(1, i, "user", "x" * n) for i, n in enumerate([40, 400, 40, 80])], "conv_id long, turn long, role string, text string")
    assert sorted(r["turn"] for r in training.budget_tail(t, 50).collect()) == [2, 3]
    assert sorted(r["turn"] for r in training.budget_head(t, 50).collect()) == [0, 2, 3]


def test_lcs_against_the_table():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(0, 30)).tolist(), rng.integers(0, 4, rng.integers(0, 30)).tolist()
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert evaluation.lcs(a, b) == t[-1, -1]


def test_bleu_of_equal_texts_is_one(spark):
    r = spark.createDataFrame([(1, "a b c d e", "a b c d e")], "id long, prediction string, reference string")
    assert evaluation.bleu(r).first()["bleu"] == pytest.approx(1.0)


def test_dbscan(spark):
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal(0, 0.2, (30, 2)), rng.normal(5, 0.2, (20, 2)), [[100, 100]]])
    d = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "vec_id long, embedding array<double>")
    got = [r["cluster"] for r in vectors.dbscan(d, 0.8, 3).orderBy("vec_id").collect()]
    assert len(set(got[:30])) == 1 and len(set(got[30:50])) == 1 and got[0] != got[30] and got[50] == -1


def test_pca_and_agglomerative(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 4)) @ np.diag([3, 1, 0.5, 0.1])
    d = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "vec_id long, embedding array<double>")
    m = vectors.pca(d, 4, size=4)
    assert np.allclose(m["components"] @ m["components"].T, np.eye(4), atol=1e-8) and m["ratio"].sum() == pytest.approx(1)
    two = spark.createDataFrame([(i, [float(i // 5 * 10 + i % 5)]) for i in range(10)], "vec_id long, embedding array<double>")
    for linkage in ("single", "complete", "average", "ward"):
        got = [r["cluster"] for r in vectors.agglomerative(two, 2, linkage).orderBy("vec_id").collect()]
        assert len(set(got[:5])) == 1 and len(set(got[5:])) == 1 and got[0] != got[5]


def test_gae(spark):
    s = spark.createDataFrame([(1, t, 1.0, 0.5, 0.5, t == 2) for t in range(3)], "episode long, t long, reward double, value double, next_value double, done boolean")
    got = [r["advantage"] for r in vectors.gae(s, 0.9, 0.8).orderBy("t").collect()]
    d, last = 1 + 0.45 - 0.5, 0.5
    assert got == pytest.approx([d + 0.72 * (d + 0.72 * last), d + 0.72 * last, last])


def test_whole_documents_are_packed(spark, tmp_path, monkeypatch):
    """Against brute force over every token of the documents' own tokenizer, past the first line and past 200 of them."""
    import re

    from quern.plans import q_training

    n = 128
    monkeypatch.setattr(q_training, "LENGTH", n)
    texts = ["ab cd " * 300 + "\nsecond line\n" + "é😀 " * 200, "", "x", None, "tail\n" * 90, "z 1" * 127, "q." * 255]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    t = q_training.trained(spark, str(tmp_path))
    one, number = t.encode_word(), {p: i for i, p in enumerate(t.vocabulary)}
    words = lambda s: [w.replace(" ", tokenizers.SPACE) for w in re.findall(r" ?[a-zA-Z]+| ?[0-9]+| ?[^\s\w]+", s or "")]
    codes = {i: [number.get(p, tokenizers.UNK) for w in words(s) for p in one(w)] for i, s in enumerate(texts)}
    flat = [x for i in sorted(codes) for x in [*codes[i], 3]]
    run = lambda f: f(spark, str(tmp_path)).collect()
    assert len(flat) > 4 * n
    assert {r["block_id"]: r["input_ids"] for r in run(q_training.ds_pack_whole)} == {i: flat[i * n : i * n + n] for i in range(len(flat) // n)}
    clm = {r["block_id"]: (r["input_ids"], r["labels"]) for r in run(q_training.ds_clm_whole)}
    assert set(clm) == set(range(-(-(len(flat) - n) // n)))
    for i, (ids, labels) in clm.items():
        assert ids == flat[i * n : i * n + n] and labels == [-100 if t == 3 else flat[i * n + k + 1] for k, t in enumerate(ids)]
    assert run(q_training.w_pack_whole)[0].asDict() == {"tokens": len(flat), "blocks": len(flat) // n}
    assert {r["doc_id"]: len(r["labels"]) for r in run(q_training.ds_mlm)} == {i: len(c) for i, c in codes.items()}
    collated = {r["doc_id"]: r for r in run(q_training.ds_collate_whole)}
    assert {len(r["input_ids"]) for r in collated.values()} == {max(map(len, codes.values()))} and {i: sum(r["attention_mask"]) for i, r in collated.items()} == {i: len(c) for i, c in codes.items()}
    encoded = {}
    for r in sorted(run(q_training.tk_encode_whole), key=lambda r: (r["doc_id"], r["part"])):
        assert r["ids"][0] == 2 and r["ids"][-1] == 3 and len(r["ids"]) <= n
        encoded.setdefault(r["doc_id"], []).extend(r["ids"][1:-1])
    assert encoded == {i: c for i, c in codes.items() if c}
    fixed = {r["doc_id"]: r["input_ids"] for r in run(q_training.ds_fixed_whole)}
    assert all(fixed[i] == (c + [0] * n)[:n] for i, c in codes.items())
    assert {r["doc_id"]: r["input_ids"] for r in run(q_training.ds_jsonl)} == {i: (c + [0] * n)[:n] for i, c in codes.items() if c}


def test_near_leaves_out_null_and_empty_texts(spark):
    text = "a text that is long enough to have many shingles of five characters"
    d = spark.createDataFrame([(0, None), (1, ""), (2, "abc"), (3, text), (4, text + ".")], "doc_id long, text string")
    assert {r["doc_id"] for r in dedup.near(d).collect()} == {2, 3}


def test_copies_make_one_class_and_no_pairs(spark):
    d = spark.createDataFrame([(i, "the same text for all of these rows") for i in range(50)] + [(90, "something else entirely, on its own")], "doc_id long, text string")
    got = dedup.lsh(dedup.signatures(d)).collect()
    assert {(r["class"], r["links"]) for r in got} == {(0, 0), (90, 0)} and len(got) == 51


def test_stored_signatures_keep_near_copies_out(spark, tmp_path):
    a, b = "one text of some length about nothing in particular, for a test", "another text that has nothing in common with the first one at all"
    d = spark.createDataFrame([(1, a), (2, a + "!"), (3, b), (4, b)], "doc_id long, text string")
    dedup.remember_signatures(d.filter("doc_id = 1"), str(tmp_path / "s"))
    got = dedup.near_unseen(d.filter("doc_id > 1"), spark.read.parquet(str(tmp_path / "s")))
    assert [r["doc_id"] for r in got.collect()] == [3]


def test_language_rules(spark):
    from quern.operators import language

    profile = spark.createDataFrame([("en", t, i) for i, t in enumerate(["the", "ing", "and", "ion"], 1)] + [("fr", t, i) for i, t in enumerate(["les", "ent", "ais", "que"], 1)], "lang string, trigram string, rank int")
    english = "the king and the nation and the thing and the ration standing and landing in the evening with the motion"
    texts = [english, "short", None, "汉语文字" * 40, "العربية " * 30, "1 2 3 " * 40, english.replace("e", "é")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    find = language.detector(profile)
    got = {r["doc_id"]: (r["x"]["lang"], r["x"]["confidence"], r["ok"]) for r in d.select("doc_id", find(F.col("text")).alias("x"), language.allowed(find(F.col("text"))).alias("ok")).collect()}
    assert got[0] == ("en", 1.0, True)  # Latin letters make English sure
    assert got[1] == got[2] == got[5] == ("unknown", 0.0, False)
    assert got[3] == ("zh", 1.0, False) and got[4] == ("ar", 1.0, False)


def test_trained_apart_finds_the_same_merges(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abcde"), int(rng.integers(1, 8)))) for _ in range(150)})
    counts = spark.createDataFrame([(w, int(rng.integers(1, 9))) for w in words], "word string, n long").coalesce(1)
    here, pieces = tokenizers.train_bpe(counts, 60), tokenizers.train_wordpiece(counts, 40)
    monkeypatch.setattr(tokenizers, "TRAIN_WORDS", 0)
    assert tokenizers.train_bpe(counts, 60) == here
    assert tokenizers.train_wordpiece(counts, 40) == pieces


def test_rounds_of_live_pairs_find_the_same_merges(spark, monkeypatch):
    """Small rounds, few runs and parts that are made in several ways."""
    for seed, least in ((1, 2), (3, 4)):
        rng = np.random.default_rng(seed)
        words = sorted({"".join(rng.choice(list("abc" if seed < 3 else "abcdefgh"), int(rng.integers(1, 12)))) for _ in range(200)})
        counts = spark.createDataFrame([(w, int(rng.integers(1, 30))) for w in words], "word string, n long").coalesce(2)
        with monkeypatch.context() as m:
            here, pieces = tokenizers.train_bpe(counts, 60, least), tokenizers.train_wordpiece(counts, 40, least)
            m.setattr(tokenizers, "TRAIN_WORDS", 0)
            for live, runs in ((6, 200_000), (16, 60)):
                m.setattr(tokenizers, "LIVE_PAIRS", live)
                m.setattr(tokenizers, "RUNS", runs)
                assert tokenizers.train_bpe(counts, 60, least) == here
                assert tokenizers.train_wordpiece(counts, 40, least) == pieces


def test_tokenizers_are_saved_and_loaded(spark, tmp_path):
    counts = spark.createDataFrame([("Ġlow", 5), ("low", 3), ("Ġlower", 2)], "word string, n long")
    merges, vocabulary = tokenizers.train_bpe(counts, 40)
    t = tokenizers.Tokenizer(vocabulary, merges)
    t.save(spark, str(tmp_path / "t"))
    assert tokenizers.load(spark, str(tmp_path / "t")) == t
    d = spark.createDataFrame([(1, "low lower")], "doc_id long, text string")
    assert t.encode(d).collect() == tokenizers.load(spark, str(tmp_path / "t")).encode(d).collect()
    more = t.extended(["new", vocabulary[0]])
    assert more.vocabulary == [*vocabulary, "new"]
    w = tokenizers.Tokenizer(tokenizers.train_wordpiece(counts, 30))
    w.save(spark, str(tmp_path / "w"))
    assert tokenizers.load(spark, str(tmp_path / "w")) == w
    write_small(spark, str(tmp_path / "w" / "tokenizer_config.json"), '{"tokenizer_class": "X"}')
    with pytest.raises(ValueError):
        tokenizers.load(spark, str(tmp_path / "w"))


def test_micro_batches(spark):
    from quern.operators import usage

    rows = [(1, i, i) for i in range(40)] + [(1, 100, 70), (2, 200, 5)]
    got = {(r["key"], r["batch_ms"]): r["size"] for r in usage.micro_batches(spark.createDataFrame(rows, "key long, id long, ts_ms long")).collect()}
    assert got == {(1, 0): 16, (1, 16): 16, (1, 32): 8, (1, 70): 1, (2, 5): 1}


def test_islands_are_replayed_together(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i % 3, i, int(t)) for i, t in enumerate(np.cumsum(rng.choice([0, 1, 7, 19, 20, 400], 900)))]
    d = spark.createDataFrame(rows, "key long, id long, ts_ms long")
    want = sorted(map(tuple, usage.micro_batches(d).collect()))
    assert usage.islands(d, 20).select("key", "__q_island").distinct().count() == 3  # not a group for each of hundreds
    monkeypatch.setattr(usage, "TOGETHER", 1)  # a group for each
    assert sorted(map(tuple, usage.micro_batches(d).collect())) == want


def test_delays_of_many_requests_of_a_domain(spark):
    d = spark.range(5_000).select(F.lit(1).cast("long").alias("domain"), "id", F.col("id").alias("ts_ms"))
    assert usage.domain_schedule(d, 600_000).agg(F.max("start_ms")).first()[0] == 4_999 * 600_000


def test_trigrams_are_counted_without_a_shuffle_of_them(spark):
    from collections import defaultdict

    from quern.operators import language

    texts = [(1, "the theme the"), (2, "ab"), (3, None), (None, "abcabc abc"), (None, "abc"), (4, "é𝒳y é𝒳y"), (4, "y é𝒳y"), (5, "word " * 900)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    want = defaultdict(lambda: [0, 1 << 30])
    for r in d.select("doc_id", language.middle(language.language_form(F.col("text"))).alias("t")).collect():
        for i in range(len(r["t"] or "") - 2):
            if (g := r["t"][i : i + 3])[0] != " " and g[2] != " ":
                x = want[r["doc_id"], g]
                x[0], x[1] = x[0] + 1, min(x[1], i)
    found = language.trigrams(d)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr((*k, *x)) for k, x in want.items())
    assert found.schema.simpleString() == "struct<doc_id:bigint,trigram:string,n:bigint,first_pos:int>"


def test_chains_of_neighbours_merge_as_the_nearest_pairs_do(spark):
    from quern.operators import vectors

    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 3))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for linkage in ("average", "complete", "single"):
        clusters = [[i] for i in range(40)]
        far = np.linalg.norm(x[:, None] - x[None], axis=2)
        gap = {"average": np.mean, "complete": np.max, "single": np.min}[linkage]
        while len(clusters) > 6:
            i, j = min(((i, j) for i in range(len(clusters)) for j in range(i)), key=lambda p: gap(far[np.ix_(clusters[p[0]], clusters[p[1]])]))
            clusters[j] += clusters.pop(i)
        got = {}
        for r in vectors.agglomerative(d, 6, linkage).collect():
            got.setdefault(r["cluster"], set()).add(r["vec_id"])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, clusters))


def test_agglomerative_beyond_one_task(spark, monkeypatch):
    from quern.operators import linkage, vectors

    monkeypatch.setattr(linkage, "BOUNDED", 9)
    monkeypatch.setattr(linkage, "BLOCK", 12)
    monkeypatch.setattr(linkage, "CHUNK", 5)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 3)) + rng.integers(0, 3, size=(60, 1)) * 4
    x[50:] = x[[3, 3, 3, 7, 7, 9, 20, 21, 22, 3]]  # copies
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for kind in ("average", "ward"):
        clusters = [[i] for i in range(60)]
        far = np.linalg.norm(x[:, None] - x[None], axis=2)
        gap = {"average": np.mean, "complete": np.max, "single": np.min}.get(kind)
        ward = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        while len(clusters) > 7:
            cost = lambda p: ward(clusters[p[0]], clusters[p[1]]) if gap is None else gap(far[np.ix_(clusters[p[0]], clusters[p[1]])])
            i, j = min(((i, j) for i in range(len(clusters)) for j in range(i)), key=cost)
            clusters[j] += clusters.pop(i)
        got = {}
        for r in vectors.agglomerative(d, 7, kind).collect():
            got.setdefault(r["cluster"], set()).add(r["vec_id"])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, clusters))
        assert [min(got[c]) for c in sorted(got)] == sorted(min(c) for c in clusters)


def test_dbscan_of_dense_points_with_copies_equals_the_definition(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1.2, (150, 2)), rng.uniform(-8, 8, (60, 2)), np.repeat([[5.0, -6.0], [7.5, 7.5]], [6, 2], axis=0)]).round(2)
    d = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "vec_id long, embedding array<double>")
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.7 * 0.7
    core = near.sum(1) >= 4
    label = np.where(core, np.arange(len(x)), len(x))
    for _ in range(len(x)):
        label = np.where(core, np.where(near & core[None], label[None], len(x)).min(1), label)
    label = np.where(core, label, np.where(near & core[None], label[None], len(x)).min(1))
    monkeypatch.setattr(vectors, "neighbours", lambda *a: pytest.fail("all pairs within eps were stored"))
    got = sorted(tuple(r) for r in vectors.clustered(d, 0.7, 4).collect())
    assert got == [(i, int(c) if c < len(x) else -1, bool(k)) for i, (c, k) in enumerate(zip(label, core, strict=True))]
