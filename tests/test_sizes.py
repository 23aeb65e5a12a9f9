"""Steps whose cost must follow their input."""

import random
import time

import pytest

from quern.operators import tokenizers


@pytest.mark.parametrize("letters", ["ab", "abcdef"])
def test_a_merge_looks_at_its_own_places_alone(letters):
    """One long word: reading it again for each merge would take minutes."""
    r = random.Random(3)
    word = r.choices(letters, k=200_000)
    vocabulary, began = [], time.perf_counter()
    merges = tokenizers._merge([(word, 2)], 2, 400, vocabulary, set())
    assert time.perf_counter() - began < 20
    assert len(merges) == 400
    for pair in merges:
        count = {}
        for p in zip(word, word[1:], strict=False):
            count[p] = count.get(p, 0) + 2
        assert pair == min(count, key=lambda p: (-count[p], p))
        word = tokenizers.merged(word, pair)
        if len(word) < 20_000:
            break


def test_perplexity_stores_its_trigrams_twice(spark, monkeypatch):
    """Once counted with their contexts and once with probabilities; no row a text and trigram is stored."""
    from pyspark.sql import functions as F

    from quern.operators import perplexity

    stored = []
    monkeypatch.setattr(perplexity, "written", lambda df, name, write=perplexity.written: stored.append((name, out := write(df, name))) or out)
    texts = [f"word{i % 7} and word{i % 5} then word{i % 3}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = perplexity.gate(docs, None, F.col("doc_id") % 5 == 0)
    assert [name for name, _ in stored] == ["trigrams", "bigrams", "unigrams", "logs"]
    assert len({df.count() for name, df in stored if name in ("trigrams", "logs")}) == 1
    # The same figures by the model of the training texts alone and scoring them as texts of others.
    model = perplexity.fit(docs.filter("doc_id % 5 <> 0"))
    apart = {r["doc_id"]: r["perplexity"] for r in perplexity.score(docs, model).collect()}
    assert {r["doc_id"]: r["perplexity"] for r in out.collect()} == pytest.approx(apart)


def test_forms_of_texts_in_tasks_are_those_of_sql(spark):
    from pyspark.sql import functions as F

    from quern.functions.text import language_form
    from quern.operators import language

    texts = ["", " ", "a", "  Ab\t c d ", "ÀÉ×÷ÿß İı K Å", "日本 中文、。 العَرَبِية ؟ 12", "x😀y😀 😀", "end.\n", "\x85z\x1cq\x0b", "".join(map(chr, range(1, 0x2100)))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", language_form(F.col("text")).alias("form")).collect()
    assert ["".join(map(chr, language.formed(r["text"]))) for r in rows] == [r["form"] for r in rows]
    assert [language._middle(language.formed("ab " * n)).tolist() == [ord(c) for c in ("ab " * n).strip()[max(0, (3 * n - 1 - 3000) // 2) :][:3000]] for n in (1, 1000, 1001, 1002, 1500)] == [True] * 5


def test_profiles_are_learned_once(spark):
    from quern.operators import language

    docs = spark.createDataFrame([(i, "the cat sat on the mat " * 9, "en") for i in range(5)], "doc_id long, text string, lang string")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    language.detector(language.profiles(docs.mapInArrow(seen, docs.schema)))
    assert read.value == 5


def test_repeats_are_counted_apart_by_text(spark):
    from pyspark.sql import functions as F

    from quern.operators import evaluation, quality

    texts = ["a b c d e f g h i j " * 3, " ".join(map(str, range(25))), "a " * 40, "a " * 19, None, "", "a b c d e f g h i j " * 2 + "x y z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", quality.ngram_repetition(F.col("t")).alias("r")).collect()
    want = {0: 3 * 10 / 30, 1: 10 / 25, 2: 31 * 10 / 40, 3: 0.0, 4: 0.0, 5: 0.0, 6: 2 * 10 / 23}
    assert {r["i"]: r["r"] for r in rows} == pytest.approx(want)
    # Pairs of tokens: structs were compared each with each, minutes for these.
    began = time.perf_counter()
    long = spark.range(8).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("w"))
    got = long.select(evaluation.shaped_reward(F.lit(0.0), F.col("w"), 50, 300, 0.0, 1.0).alias("r")).collect()
    assert {r["r"] for r in got} == {0.0} and time.perf_counter() - began < 30


def test_likeness_of_pairs_needs_texts_alone(spark):
    import random as rnd

    from quern.operators import dedup

    r = rnd.Random(5)
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 5_000)))
    texts = ["", None, "abcd", "abcde", "abcdeabcde", "日本語のテキスト", "日本語のテキスト と abcde", wide, wide[:3_000] + "x", *("".join(r.choices("abc 😀", k=40)) for _ in range(8))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = spark.createDataFrame([(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))], "i long, j long")
    out = dedup.jaccard_exact(pairs, docs)
    sets = [{(t or "")[k : k + 5] for k in range(len(t or "") - 4)} for t in texts]
    want = {(i, j): len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for i in range(len(sets)) for j in range(i + 1, len(sets))}
    assert {(x["i"], x["j"]): x["jaccard"] for x in out.collect()} == want
    assert "array<string>" not in out._jdf.queryExecution().optimizedPlan().treeString() and "array_distinct" not in out._jdf.queryExecution().toString()


def test_words_are_encoded_together_as_one_by_one():
    """Many rare words: each took a search of its own for every merge."""
    r = random.Random(7)
    for seed in range(40):
        parts, merges = list("abc"), []
        for _ in range(seed % 13):
            merges.append((r.choice(parts), r.choice(parts)))
            parts.append("".join(merges[-1]))
        coder = tokenizers.BpeWords(merges, frozenset(["ab"] if seed % 2 else []))
        ids = {t: i + 20 for i, t in enumerate(dict.fromkeys(parts[: r.randint(1, len(parts))]))}
        words = ["".join(r.choices("abcdé😀", [5, 3, 2, 0.3, 0.2, 0.2], k=r.randint(0, 14))) for _ in range(60)] + ["ab", "a" * 99]
        sizes, flat = coder.many(ids)(words)
        want = [[ids.get(t, tokenizers.UNK) for t in coder(w)] for w in words]
        assert sizes.tolist() == list(map(len, want)) and flat.tolist() == [i for x in want for i in x]
    merges = tokenizers._merge([(r.choices("abcdefgh", k=100_000), 2)], 2, 600, [], set())
    words = ["".join(r.choices("abcdefgh", k=14)) for _ in range(200_000)]
    code, began = tokenizers.BpeWords(merges).many({}), time.perf_counter()
    assert code(words)[0].sum() > 0 and time.perf_counter() - began < 8


@pytest.mark.parametrize("beyond", [False, True])
def test_blocks_make_ids_once_and_shuffle_none_of_them(spark, beyond):
    from pyspark.sql import functions as F

    from quern.operators import training

    docs = spark.createDataFrame([(i * 7 % 40, "x" * (i % 9)) for i in range(40)], "doc_id long, text string").repartition(3)
    made = spark.sparkContext.accumulator(0)

    def ids(rows):
        def each(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(each, rows.schema).select("doc_id", F.transform(F.split("text", ""), lambda _, i: (i + 12).cast("int")).alias("ids"))

    plain = ids(docs).select("doc_id", "ids")
    f = training.causal if beyond else training.pack
    want = sorted(map(tuple, f(plain, 4).collect()))
    made.value = 0
    assert sorted(map(tuple, f(docs, 4, ids=ids).collect())) == want and want
    assert made.value == 40
    made.value = 0
    got = training.batches(docs, "doc_id", 3, ids)
    want = {(r["doc_id"], len(r["ids"])) for r in plain.collect()}
    made.value = 0
    rows = got.collect()
    assert made.value == 40 and {(r["doc_id"], sum(r["attention_mask"])) for r in rows} == want
    longest = {}
    for r in rows:
        longest[r["batch"]] = max(longest.get(r["batch"], 0), sum(r["attention_mask"]))
        assert r["batch"] == r["doc_id"] // 3
    assert all(len(r["input_ids"]) == longest[r["batch"]] for r in rows)


def test_masks_come_from_hashes_of_key_and_place(spark):
    from pyspark.sql import functions as F

    from quern.operators import training

    ids = [[*range(5, 105)], [], None, [3, 4], [13] * 30]
    for kind, keys in (("long", [5, 6, 7, 8, None]), ("string", list("abcde"))):
        docs = spark.createDataFrame(list(zip(keys, ids)), f"doc_id {kind}, ids array<int>")
        out = training.masked(docs, 500)
        # In tasks: hashes of structs of every place were sorted in Spark.
        assert "sort" not in out._jdf.queryExecution().optimizedPlan().toString()
        h = lambda i, salt: F.pmod(F.xxhash64(F.col("doc_id"), i, F.lit(7), F.lit(salt)), F.lit(1 << 30))
        hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.transform("ids", lambda t, i: F.array(h(i, 1), h(i, 2), h(i, 3))).alias("h")).collect()}
        for r in out.collect():
            x = ids[keys.index(r["doc_id"])]
            if x is None:
                assert r["input_ids"] is None and r["labels"] is None
                continue
            places = sorted((hashes[r["doc_id"]][i][0], i) for i, t in enumerate(x) if t > 11)
            chosen = {i for _, i in places[: max(1, int(len(places) * 0.15))]}
            new = {i: (4 if k % 10 < 8 else 12 + n % 488 if k % 10 == 8 else x[i]) for i in chosen for _, k, n in [hashes[r["doc_id"]][i]]}
            assert r["labels"] == [t if i in chosen else -100 for i, t in enumerate(x)]
            assert r["input_ids"] == [new.get(i, t) for i, t in enumerate(x)]


def test_hits_of_a_search_are_dealt_before_they_are_counted(spark, tmp_path, monkeypatch):
    from quern.sources import memory

    monkeypatch.setattr(memory, "HITS", 100)
    m = memory.Memory(spark, str(tmp_path / "m"), 4)
    m.store(spark.createDataFrame([(i, f"common word{i % 9}", "semantic", None) for i in range(900)], "id long, text string, kind string, source string"))
    found = m.search(spark.createDataFrame([(1, "common word7"), (2, "word3")], "query_id long, text string"))
    # 900 and 100 hits by words of the first query, 100 of the second.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 11" in plan.split("RepartitionByExpression")[1].split("\n")[0]
    assert [(r["query_id"], r["rank"], r["id"], r["score"]) for r in found.orderBy("query_id", "rank").collect()][:6] == [(1, i + 1, 7 + 9 * i, 2) for i in range(5)] + [(2, 1, 3, 1)]


def test_pages_go_to_workers_in_small_batches(spark, tmp_path):
    from quern.plans import corpus_build, q_text
    from quern.session import _BATCH, BATCH_BYTES

    spark.createDataFrame([(1, "u", "<p>" + "a long paragraph " * 5 + "</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for made in (lambda: q_text.html_paragraphs(spark, str(tmp_path)), lambda: corpus_build.extracted(spark.read.parquet(str(tmp_path / "pages.parquet")))):
        spark.conf.unset(_BATCH)
        assert made().count() == 1 and int(spark.conf.get(_BATCH)) == BATCH_BYTES


def test_clusters_are_joined_in_rounds_of_squares_of_tiles(spark, monkeypatch):
    """A chain across many tiles, on both sides of zero, and one beside it: spreading labels would take a round a step."""
    from quern.operators import vectors
    from quern.plans import lineage

    chain = [[(i - 300) * 0.9, (i - 300) * 0.5] for i in range(600)]
    points = chain + [[x, y + 6.0] for x, y in chain[::-1]] + [[0.0, 40.0], [0.0, 40.0]]
    d = spark.createDataFrame(list(enumerate(points)), "vec_id long, embedding array<double>")
    stored = []
    monkeypatch.setattr(lineage, "written", lambda df, name="table", write=lineage.written: stored.append(name) or write(df, name))
    monkeypatch.setattr(lineage, "cut", lambda df: pytest.fail("a round over all cells"))
    monkeypatch.setattr(vectors, "TILE", 3)
    got = {r["vec_id"]: (r["cluster"], r["core"]) for r in vectors.clustered(d, 1.1, 3).collect()}
    assert stored.count("joined") <= 3
    # Ends of the chains have two points within reach: they are border points of the next.
    assert {c for i, (c, _) in got.items() if i < 600} == {1} and {c for i, (c, _) in got.items() if 600 <= i < 1200} == {601}
    assert [i for i, (_, k) in got.items() if i < 1200 and not k] == [0, 599, 600, 1199] and got[1200] == got[1201] == (-1, False)


def test_perplexity_in_slices_keeps_one_slice_of_trigrams(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quern.operators import perplexity
    from quern.plans import lineage

    texts = [" ".join(f"w{(i * i + k * k * (i % 7 + 1)) % 23}" for k in range(i % 19)) for i in range(80)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: tuple(r)[2:] for r in perplexity.gate(docs, 20.0, F.col("doc_id") % 5 == 0).collect()}
    there = []
    write = perplexity.written
    monkeypatch.setattr(perplexity, "written", lambda df, name: there.append(sum("quern-trigrams" in t for t in lineage.tables(spark))) or write(df, name))
    monkeypatch.setattr(perplexity, "SLICE_BYTES", sum(len(t or "") for t in texts) // 3)
    before = sum("quern-trigrams" in t for t in lineage.tables(spark))
    got = {r["doc_id"]: tuple(r)[2:] for r in perplexity.gate(docs, 20.0, F.col("doc_id") % 5 == 0).collect()}
    assert max(there) == before + 1 and len(there) > 20
    assert got.keys() == whole.keys()
    for i, (n, p, held, kept) in got.items():
        assert (n, held, kept) == (whole[i][0], whole[i][2], whole[i][3]) and p == pytest.approx(whole[i][1])
