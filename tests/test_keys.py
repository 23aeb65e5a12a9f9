"""Operators that order or name rows by an id, on ids that are null, shared by unlike texts, or repeated as whole rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.operators import corpus, dedup, training

LONG = "the quick brown fox jumps over the lazy dog and runs away from all of them at once "
ROWS = [
    (1, "x"), (1, "x"), (None, "a unique text"), (None, "another text"), (2, "c"), (2, "C  "), (3, "c"), (None, "X"), (None, "only here"), (None, "only here"),
    (4, ""), (5, None), (None, None), (6, LONG * 3), (6, LONG * 3 + "end"), (None, LONG * 3), (7, "solo"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def key(spark, rows):
    h = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in rows], "text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    return lambda r: (r[0] is None, r[0] or 0, h[r[1]])


def test_exact_keeps_one_row_of_each_content(spark, docs):
    order, first = key(spark, ROWS), {}
    for r in ROWS:
        if r[1] and r[1].strip():
            form = " ".join(r[1].lower().split())
            first[form] = min(first.get(form, r), r, key=order)
    got = [(r["doc_id"], r["text"]) for r in dedup.exact(docs).collect()]
    assert Counter(got) == Counter(first.values())
    seen = docs.filter("doc_id = 7").select(dedup.content_hash(F.col("text")).alias("content_hash"))
    assert Counter((r["doc_id"], r["text"]) for r in dedup.unseen(docs, seen).collect()) == Counter(first.values()) - Counter([(7, "solo")])


def test_near_keeps_one_row_of_each_likeness(spark, docs):
    order = key(spark, ROWS)
    rows = [r for r in ROWS if r[1]]
    sig = {r["text"]: r["signature"] for r in dedup.signatures(docs.filter("text <> ''").select("doc_id", "text").distinct(), "text", ["doc_id", "text"]).collect()}
    like = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) / 128
    want = Counter(r for r in set(rows) if not any(order(e) < order(r) and like(e[1], r[1]) >= 0.85 for e in rows))
    got = Counter((r["doc_id"], r["text"]) for r in dedup.near(docs).collect())
    # Texts of less than five characters have no shingles: they are alike.
    assert got == want and sum(got.values()) < len(rows)
    old = dedup.signatures(docs.filter("doc_id = 7"))
    assert (7, "solo") not in {(r["doc_id"], r["text"]) for r in dedup.near_unseen(docs, old).collect()}


@pytest.mark.parametrize("few, block", [(1, 3), (2, 1000), (200, 1000)])
def test_bands_of_many_classes_are_compared_in_blocks(spark, monkeypatch, few, block):
    import numpy as np

    monkeypatch.setattr(dedup, "FEW", few)
    monkeypatch.setattr(dedup, "BLOCK", block)
    monkeypatch.setattr(dedup, "AT_ONCE", 4)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 32, 128)
    rows = []
    for i in range(60):
        s = base.copy()
        change = rng.choice(128, int(rng.integers(0, 40)), replace=False)
        s[change] = rng.integers(0, 1 << 32, len(change))
        rows.append((i, s.tolist()))
    got = {r["id"] for r in dedup.resembling(spark.createDataFrame(rows, "id long, signature array<long>").repartition(3)).collect()}
    b, r = dedup.bands_for()
    met = lambda x, y: any(x[k * r : k * r + r] == y[k * r : k * r + r] for k in range(b))
    want = {j for j, y in rows for i, x in rows if i < j and met(x, y) and sum(p == q for p, q in zip(x, y, strict=True)) / 128 >= 0.85}
    assert got == want and len(want) > 10


def test_ranks_number_every_row_once(docs):
    got = corpus.ranks(docs, ["doc_id"], "r").collect()
    assert sorted(r["r"] for r in got) == list(range(1, len(ROWS) + 1))
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(ROWS)
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["r"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_splits_hold_every_row_once(docs):
    n = len(ROWS)
    for f, sizes in ((corpus.split, (-(-n * 3 // 10), -(-n * 2 // 10))), (corpus.split_floor, None)):
        got = f(docs, *((0.2, 0.3) if f is corpus.split else (0.5, 0.2))).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(ROWS)
        if sizes:
            assert Counter(r["split"] for r in got)["test"] == sizes[0] and Counter(r["split"] for r in got)["val"] == sizes[1]


@pytest.mark.parametrize("block", [1, 3, 6, 50])
def test_blocks_hold_every_token_once(spark, block):
    ids = [(1, [20, 21]), (1, [20, 21]), (None, [30] * 7), (None, []), (2, list(range(40, 55))), (2, [60])]
    rows = spark.createDataFrame(ids, "doc_id long, ids array<int>").repartition(3)
    total = sum(len(x) + 1 for _, x in ids)
    packed = training.pack(rows, block).orderBy("block_id").collect()
    assert len(packed) == total // block
    flat = [t for r in packed for t in r["input_ids"]]
    assert not Counter(flat) - Counter([t for _, x in ids for t in [*x, training.EOS]]) and len(flat) == total // block * block
    whole = [tuple(x) for x in "".join(chr(t) for t in flat).split(chr(training.EOS))]
    assert not flat or all(tuple(map(chr, x)) in whole for _, x in ids[:1])
    causal = training.causal(rows, block).orderBy("block_id").collect()
    for r in causal:
        x = [*flat, *([-1] * block)][r["block_id"] * block :][:block]
        assert r["input_ids"] == x
    padded = training.batches(rows, "doc_id", 2).collect()
    assert Counter((r["doc_id"], sum(r["attention_mask"])) for r in padded) == Counter((i, len(x)) for i, x in ids)


@pytest.fixture(scope="module")
def tokenizer(spark):
    from quern.operators import tokenizers

    docs = spark.createDataFrame([("the cat sat on the mat and the dog sat too",)] * 3, "text string")
    merges, vocabulary = tokenizers.train_bpe(tokenizers.word_counts(docs, tokenizers.pretokens(F.col("text"))), 60)
    return tokenizers.Tokenizer(vocabulary, merges)


def plain_ids(t, text):
    """Ids by the definition: delimiters are their own, other parts go through the tokenizer word by word."""
    import re

    from quern.operators import tokenizers

    one, out = t.encode_word(), []
    for part in re.split(r"(<\|system\|>|<\|user\|>|<\|assistant\|>|<\|end_turn\|>|<eos>)", text):
        if part in tokenizers.SPECIALS:
            out.append(t.vocabulary.index(part))
            continue
        for w in re.findall(r" ?[a-zA-Z]+| ?[0-9]+| ?[^\s\w]+", part):
            out += [t.vocabulary.index(p) if p in t.vocabulary else tokenizers.UNK for p in one(w.replace(" ", tokenizers.SPACE))]
    return out


def test_chats_as_padded_ids_with_labels_on_answers(spark, tokenizer):
    turns = [(1, 0, "system", "sat"), (1, 1, "user", "the cat"), (1, 2, "assistant", "sat on"), (2, 0, "user", " the dog "), (2, 1, "assistant", "the mat"), (3, 0, "user", "q"), (None, 0, "user", "the")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    texts = {r["conv_id"]: r["text"] for r in training.chat_text(frame).collect()}
    for longest in (12, 64):
        got = {r["conv_id"]: r for r in training.chat_ids(frame, tokenizer, longest).collect()}
        assert set(got) == {1, 2, 3, None}
        for i, r in got.items():
            ids = plain_ids(tokenizer, texts[i])[:longest]
            pad = [0] * (longest - len(ids))
            inside, mask = False, []
            for t in ids:
                if t == training.ASSISTANT:
                    inside, said = True, False
                elif t == training.END_TURN:
                    inside, said = False, False
                else:
                    said = inside
                mask.append(said)
            following = ids[1:] + [training.EOS if not pad else 0]
            assert r["input_ids"] == ids + pad and r["attention_mask"] == [1] * len(ids) + pad
            assert r["labels"] == [t if m else -100 for t, m in zip(following, mask, strict=True)] + [-100] * len(pad)
    assert training.chat_ids(frame, tokenizer, 64, least=1000).count() == 0


def test_pairs_as_padded_ids(spark, tokenizer):
    rows = [(1, " the cat ", "sat on", "the mat"), (1, " the cat ", "sat on", "the mat"), (None, "dog", "sat", "too"), (None, "dog", "sat", "mat"), (2, "", "a", "b"), (3, "a", None, "b")]
    got = training.preference_ids(spark.createDataFrame(rows, "id long, prompt string, chosen string, rejected string"), tokenizer, 12).collect()
    pad = lambda x: x[:12] + [0] * (12 - len(x))
    want = [(i, tuple(pad(plain_ids(tokenizer, f"{p.strip()}\n{a}<eos>"))), tuple(pad(plain_ids(tokenizer, f"{p.strip()}\n{b}<eos>")))) for i, p, a, b in rows[:4]]
    assert Counter((r["id"], tuple(r["chosen_input_ids"]), tuple(r["rejected_input_ids"])) for r in got) == Counter(want)
    assert all(sum(r["chosen_attention_mask"]) == sum(t != 0 for t in r["chosen_input_ids"]) for r in got)
