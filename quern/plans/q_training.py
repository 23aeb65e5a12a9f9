"""Queries over tokens, chats, labels and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quern.functions.calculator import calculate
from quern.functions.text import millis
from quern.operators import evaluation, tokenizers, training, vectors
from quern.plans.registry import query
from quern.session import ship, spread, table

#: Tokens for set building without a trained vocabulary: the codes of all characters, above the specials.
IDS_SQL = "CASE WHEN text = '' THEN [] ELSE list_transform(string_split(text, ''), lambda c: (unicode(c) % 500 + 12)::INT) END"


def texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def coded(spark, sf):
    return codes(spread(texts(spark, sf)))


def codes(docs):
    """doc_id and ids of docs(doc_id, text): codes of every character, a row for each in its place."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                ids, text = batch.column(0).slice(i, 256), batch.column(1).slice(i, 256).to_pylist()
                chars = [np.frombuffer((t or "").encode("utf-32-le"), np.uint32) for t in text]
                offsets = pa.array([None if t is None else int(o) for t, o in zip(text, np.cumsum([0, *map(len, chars)]))] + [sum(map(len, chars))], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array((np.concatenate(chars) % 500 + 12).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids, lists], ["doc_id", "ids"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(each, StructType([docs.schema["doc_id"], StructField("ids", ArrayType(IntegerType()))]))


def listed(c):
    """The numbers of an array, between commas."""

    @F.arrow_udf("string")
    def joined(x: pa.Array) -> pa.Array:
        flat = x.flatten().dictionary_encode()
        names = flat.dictionary.cast(pa.string()).take(flat.indices)
        sizes = x.value_lengths().fill_null(0).to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, mask=np.append(np.asarray(x.is_null()), False)), names), ",")

    return joined(c)


_LIST = "array_to_string({}, ',')"


@query(f"WITH d AS (SELECT doc_id, {IDS_SQL} AS ids FROM documents), p AS (SELECT doc_id, len(ids) AS n, list_concat(ids, list_transform(range(64), lambda i: 0::INT))[1:64] AS x FROM d) SELECT doc_id, {_LIST.format('x')} AS input_ids, least(n, 64) AS mask_sum, {_LIST.format('list_transform(x, lambda t: CASE WHEN t = 0 THEN -100 ELSE t END)')} AS labels FROM p")
def ds_fixed(spark, sf):
    f = coded(spark, sf).select("doc_id", training.fixed(F.col("ids"), 64).alias("x"))
    return f.select("doc_id", listed(F.col("x.input_ids")).alias("input_ids"), F.aggregate("x.attention_mask", F.lit(0), lambda a, b: a + b).cast("long").alias("mask_sum"), listed(F.col("x.labels")).alias("labels"))


@query(f"""WITH d AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch, {IDS_SQL} AS ids FROM documents)
SELECT doc_id, batch, {_LIST.format('list_concat(ids, list_transform(range(max(len(ids)) OVER (PARTITION BY batch) - len(ids)), lambda i: 0::INT))')} AS input_ids FROM d""")
def ds_collate(spark, sf):
    return training.dynamic_pad(texts(spark, sf), "doc_id", 16, ids=codes).select("doc_id", "batch", listed(F.col("input_ids")).alias("input_ids"))


_FLAT = f"""WITH d AS (SELECT doc_id, list_concat({IDS_SQL}, [3::INT]) AS ids FROM documents), e AS (SELECT doc_id, unnest(ids) AS token, generate_subscripts(ids, 1) AS pos FROM d),
s AS (SELECT token, row_number() OVER (ORDER BY doc_id, pos) - 1 AS place FROM e)"""


@query(f"{_FLAT} SELECT place // 128 AS block_id, string_agg(token, ',' ORDER BY place) AS input_ids FROM s GROUP BY 1 HAVING count(*) = 128")
def ds_pack(spark, sf):
    return training.pack(texts(spark, sf), 128, ids=codes).select("block_id", listed(F.col("input_ids")).alias("input_ids"))


@query(f"""{_FLAT}, n AS (SELECT place, token, lead(token) OVER (ORDER BY place) AS nxt, count(*) OVER () AS total FROM s)
SELECT place // 128 AS block_id, string_agg(token, ',' ORDER BY place) AS input_ids, string_agg(CASE WHEN token = 3 THEN -100 ELSE nxt END, ',' ORDER BY place) AS labels FROM n WHERE place // 128 < ceil((total - 128) / 128.0) GROUP BY 1""")
def ds_clm(spark, sf):
    return training.causal(texts(spark, sf), 128, ids=codes).select("block_id", listed(F.col("input_ids")).alias("input_ids"), listed(F.col("labels")).alias("labels"))


@query(f"{_FLAT} SELECT count(*) AS tokens, count(*) // 128 AS blocks FROM s")
def w_pack(spark, sf):
    n = coded(spark, sf).agg(F.sum(F.size("ids") + 1).alias("tokens"))
    return n.select("tokens", F.floor(F.col("tokens") / 128).alias("blocks"))


@query()
def ds_mlm(spark, sf):
    return training.masked(ids_of(spark, sf), len(trained(spark, sf).vocabulary))


# Sets of whole texts by a tokenizer of the documents, with the sizes that training takes.

LENGTH, PAIR_LENGTH, CHAT_LENGTH, BATCH = 1024, 512, 2048, 16
_tokenizers: dict[tuple[str, str], tokenizers.Tokenizer] = {}


def bpe_counts(spark, sf):
    return tokenizers.word_counts(table(spark, sf, "documents"), tokenizers.pretokens(F.col("text")))


def trained(spark, sf) -> tokenizers.Tokenizer:
    """The BPE tokenizer of the documents; one for each session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _tokenizers:
        merges, vocabulary = tokenizers.train_bpe(bpe_counts(spark, sf))
        _tokenizers[key] = tokenizers.Tokenizer(vocabulary, merges)
    return _tokenizers[key]


def ids_of(spark, sf):
    return trained(spark, sf).encode(spread(table(spark, sf, "documents").select("doc_id", "text")))


@query()
def ds_fixed_whole(spark, sf):
    return ids_of(spark, sf).select("doc_id", training.fixed(F.col("ids"), LENGTH).alias("x")).select("doc_id", "x.*")


@query()
def ds_collate_whole(spark, sf):
    return training.batches(texts(spark, sf), "doc_id", BATCH, trained(spark, sf).encode)


@query()
def ds_pack_whole(spark, sf):
    return training.pack(texts(spark, sf), LENGTH, ids=trained(spark, sf).encode)


@query()
def ds_clm_whole(spark, sf):
    return training.causal(texts(spark, sf), LENGTH, ids=trained(spark, sf).encode)


@query()
def w_pack_whole(spark, sf):
    n = ids_of(spark, sf).agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0)).cast("long").alias("tokens"))
    return n.select("tokens", F.floor(F.col("tokens") / LENGTH).alias("blocks"))


@query()
def tk_encode_whole(spark, sf):
    """Every document in windows of at most LENGTH - 2 tokens, each between the specials."""
    n = LENGTH - 2
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / n).cast("int")), lambda i: F.slice("ids", i * n + 1, n))
    d = ids_of(spark, sf).filter(F.size("ids") > 0).select("doc_id", F.posexplode(windows).alias("part", "ids"))
    return d.select("doc_id", "part", tokenizers.with_specials(F.col("ids"), LENGTH).alias("ids"))


@query()
def ds_jsonl(spark, sf):
    """Documents as JSON lines, read by ranges of bytes, encoded, cut and padded."""
    from quern.plans.lineage import folder
    from quern.sources import lines

    lines.register(spark)
    path = folder(spark, "jsonl")
    table(spark, sf, "documents").select("doc_id", "text").write.option("lineSep", "\n").json(path)
    read = spark.read.format("json_lines").options(path=path, suffix=".json", bytesPerTask=str(8 << 20)).load()
    docs = read.select(F.get_json_object("record", "$.doc_id").cast("long").alias("doc_id"), "text")
    ids = trained(spark, sf).encode(docs).filter(F.size("ids") > 0)
    return ids.select("doc_id", training.fixed(F.col("ids"), LENGTH).alias("x")).select("doc_id", "x.*")


_CHAT = """WITH s AS (SELECT conv_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM conversations WHERE role = 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
c AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '<|user|>' || chr(10) || trim(text, chr(32) || chr(9) || chr(10) || chr(13)) || chr(10) WHEN 'assistant' THEN '<|assistant|>' || chr(10) || trim(text, chr(32) || chr(9) || chr(10) || chr(13)) || chr(10) || '<|end_turn|>' || chr(10) ELSE '' END, '' ORDER BY turn) AS body FROM conversations GROUP BY 1)
"""


@query(_CHAT + f"SELECT c.conv_id, '<|system|>' || chr(10) || coalesce(s.text, '{training.DEFAULT_SYSTEM}') || chr(10) || body || '<eos>' AS text FROM c LEFT JOIN s ON s.conv_id = c.conv_id")
def ds_chatml(spark, sf):
    return training.chat_text(table(spark, sf, "conversations"))


@query("WITH p AS (SELECT a.conv_id, a.turn, a.text AS instruction, b.text AS response FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant') SELECT conv_id, turn, '### Instruction:' || chr(10) || instruction || chr(10) || '### Response:' || chr(10) || response || '<eos>' AS text FROM p")
def ds_alpaca(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", training.instruction_text(F.col("instruction"), F.lit(""), F.col("response")).alias("text"))


@query("SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS response_tokens, sum(length(text) + CASE role WHEN 'assistant' THEN 2 ELSE 1 END)::BIGINT AS tokens FROM conversations GROUP BY 1")
def ds_response_mask(spark, sf):
    """Each turn as its opening id, one id a character, and a closing id after responses; the mask's sums."""
    ids = F.concat(F.when(F.col("role") == "assistant", F.array(F.lit(10))).otherwise(F.array(F.lit(9))), F.array_repeat(F.lit(100), F.length("text")), F.when(F.col("role") == "assistant", F.array(F.lit(11))).otherwise(F.array().cast("array<int>")))
    # By turn: a response never crosses turns, so the folds stay short.
    t = table(spark, sf, "conversations").select("conv_id", ids.alias("ids")).select("conv_id", F.size("ids").alias("n"), F.size(F.filter(training.response_mask(F.col("ids"), 10, 11), lambda x: x)).alias("r"))
    return t.groupBy("conv_id").agg(F.sum("r").alias("response_tokens"), F.sum("n").alias("tokens"))


@query()
def ds_sft(spark, sf):
    """Whole conversations in chat form, as ids of the documents' tokenizer, cut and padded, with labels on responses only."""
    return training.chat_ids(table(spark, sf, "conversations"), trained(spark, sf), CHAT_LENGTH)


@query()
def ds_pref_ids(spark, sf):
    """Answers against those that the same conversation gave before, as padded ids."""
    c = table(spark, sf, "conversations")
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("chosen"))
    worse = a.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("chosen").alias("rejected"))
    return training.preference_ids(u.join(a, ["conv_id", "turn"]).join(worse, ["conv_id", "turn"]), trained(spark, sf), PAIR_LENGTH)


@query("WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), u AS (SELECT conv_id, turn + 1 AS turn, text FROM conversations WHERE role = 'user') SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS chosen, reverse(a.text) AS rejected FROM u JOIN a USING (conv_id, turn) WHERE length(a.text) > 0 AND length(u.text) > 0")
def ds_pref(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("chosen"), F.reverse("text").alias("rejected"))
    return training.preference_pairs(u.join(a, ["conv_id", "turn"]))


_SYSTEM, _ANSWER = f"'<|system|>' || chr(10) || '{training.DEFAULT_SYSTEM}", "<|user|>' || chr(10) || text || chr(10) || '<|assistant|>' || chr(10)"
_FORMS = {
    "system": f"{_SYSTEM}' || chr(10) || '{_ANSWER}",
    "chat": f"{_SYSTEM}' || chr(10) || '<|user|>' || chr(10) || 'Hello' || chr(10) || '<|assistant|>' || chr(10) || 'Hi.' || chr(10) || '<|end_turn|>' || chr(10) || '{_ANSWER}",
    "few_shot": f"{_SYSTEM}' || chr(10) || '<|user|>' || chr(10) || 'Hello' || chr(10) || '<|assistant|>' || chr(10) || 'Hi.' || chr(10) || '<|end_turn|>' || chr(10) || '{_ANSWER}",
    "cot": f"{_SYSTEM}{training.STEP_BY_STEP}' || chr(10) || '{_ANSWER} || replace('{training.FIRST_STEP}', chr(10), chr(10))",
    "code": f"'<|system|>' || chr(10) || '{training.CODE_SYSTEM} Language: Python.' || chr(10) || '{_ANSWER} || '```python' || chr(10)",
}


@query(" UNION ALL ".join(f"SELECT item_id, '{name}' AS form, {sql} AS prompt FROM benchmark" for name, sql in _FORMS.items()))
def ds_prompts(spark, sf):
    """Every item in each of the five forms."""
    earlier = F.array(F.struct(F.lit("Hello").alias("user"), F.lit("Hi.").alias("assistant")))
    forms = [F.struct(F.lit(name).alias("form"), training.prompt(name, F.col("text"), history=earlier).alias("prompt")) for name in _FORMS]
    return table(spark, sf, "benchmark").select("item_id", F.explode(F.array(*forms)).alias("x")).select("item_id", "x.*")


@query()
def w_budget_head(spark, sf):
    return training.budget_head(table(spark, sf, "conversations"), 300)


@query(f"WITH d AS (SELECT doc_id, {IDS_SQL} AS ids FROM documents) SELECT doc_id, {_LIST.format('CASE WHEN len(ids) = 0 THEN ids ELSE list_concat(list_concat([2::INT], ids[1:62]), [3::INT]) END')} AS ids FROM d")
def tk_encode(spark, sf):
    return coded(spark, sf).select("doc_id", listed(tokenizers.with_specials(F.col("ids"), 64)).alias("ids"))


@query()
def tk_bpe_train(spark, sf):
    merges, _ = tokenizers.train_bpe(bpe_counts(spark, sf))
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string")


@query()
def tk_bpe_encode(spark, sf):
    return ids_of(spark, sf)


@query()
def tk_wp_train(spark, sf):
    counts = tokenizers.word_counts(table(spark, sf, "documents"), tokenizers.wordpiece_words(F.col("text")))
    return spark.createDataFrame([(i, t) for i, t in enumerate(tokenizers.train_wordpiece(counts))], "id int, token string")


@query()
def tk_wp_encode(spark, sf):
    docs = table(spark, sf, "documents")
    vocabulary = tokenizers.train_wordpiece(tokenizers.word_counts(docs, tokenizers.wordpiece_words(F.col("text"))))
    known = set(vocabulary)
    return tokenizers.encode(spread(docs), tokenizers.wordpiece_words(F.col("text")), lambda w: tokenizers.encode_wordpiece_word(w, known), vocabulary)


@query("SELECT item_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '([^\\w\\s\\x{80}-\\x{10FFFF}])', ' \\1 ', 'g')), '\\s+'), lambda w: w <> '')[1] AS first_word, len(list_filter(regexp_split_to_array(lower(regexp_replace(text, '([^\\w\\s\\x{80}-\\x{10FFFF}])', ' \\1 ', 'g')), '\\s+'), lambda w: w <> ''))::INT AS n FROM benchmark")
def tk_wp_pretok(spark, sf):
    w = tokenizers.wordpiece_words(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", w[0].alias("first_word"), F.size(w).alias("n"))


@query("SELECT item_id, ltrim(replace(replace(text, ' ', 'Ġ'), 'Ġ', ' ')) AS text FROM benchmark")
def tk_bpe_decode(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tokenizers.bpe_text(F.split(F.replace("text", F.lit(" "), F.lit("Ġ")), "(?=Ġ)", -1)).alias("text"))


@query("SELECT item_id, replace(replace(text, 'th', 't ##h'), ' ##', '') AS text FROM benchmark")
def tk_wp_decode(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tokenizers.wordpiece_text(F.split(F.replace("text", F.lit("th"), F.lit("t ##h")), " ", -1)).alias("text"))


@query(r"""WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '([^\w\s\x{80}-\x{10FFFF}])', ' \1 ', 'g')), '\s+'), lambda x: x <> '')) AS w FROM documents) GROUP BY 1),
p AS (SELECT w, n, unnest(range(1, length(w))) AS i FROM w) SELECT substr(w, i, 1) AS "left", substr(w, i + 1, 1) AS "right", sum(n)::BIGINT AS n FROM p GROUP BY 1, 2""")
def a_pair_freq(spark, sf):
    return tokenizers.pair_counts(tokenizers.word_counts(table(spark, sf, "documents"), tokenizers.wordpiece_words(F.col("text"))))


def _labelled(spark, sf):
    """Verdict of a simple rule beside the label: pred 1 for documents of at least 60 words."""
    from quern.functions.text import word_count

    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(lab, "doc_id").select("doc_id", (word_count(F.col("text")) >= 60).cast("int").alias("pred"), F.col("quality").alias("label"))


_PRED = r"WITH p AS (SELECT (len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 60)::INT AS pred, quality AS label FROM documents JOIN labels USING (doc_id)) "


@query(_PRED + "SELECT round(avg((pred = label)::INT), 6) AS accuracy FROM p")
def a_accuracy(spark, sf):
    return evaluation.accuracy(_labelled(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


@query("SELECT round(avg((label IN (vec_id % 10, vec_id % 7))::INT), 6) AS accuracy FROM embeddings")
def a_top_k(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.array((F.col("vec_id") % 10).cast("int"), (F.col("vec_id") % 7).cast("int"), F.lit(-1)).alias("ranked"))
    return evaluation.top_k_accuracy(e, 2).select(F.round("accuracy", 6).alias("accuracy"))


@query(_PRED + ", c AS (SELECT k, count_if(pred = k AND label = k) AS tp, count_if(pred = k AND label <> k) AS fp, count_if(pred <> k AND label = k) AS fn FROM p, (VALUES (0), (1)) v(k) GROUP BY k) SELECT round(avg(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS f1 FROM c")
def a_f1(spark, sf):
    return evaluation.f1(_labelled(spark, sf), 2).select(F.round("f1", 6).alias("f1"))


@query("SELECT round(exp(least(sum(value) / sum(1 + event_id % 5), 100)), 6) AS perplexity FROM events")
def a_perplexity(spark, sf):
    rows = table(spark, sf, "events").select(F.col("value").alias("nll"), (1 + F.col("event_id") % 5).alias("tokens"))
    return evaluation.perplexity(rows).select(F.round("perplexity", 6).alias("perplexity"))


def _pairs(spark, sf):
    """Benchmark items against the next item, and half of them against themselves."""
    from pyspark.sql import Window

    b = table(spark, sf, "benchmark")
    nxt = F.coalesce(F.lead("text").over(Window.orderBy("item_id")), F.col("text"))  # tens to hundreds of items
    return b.select(F.col("item_id").alias("id"), F.col("text").alias("prediction"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(nxt).alias("reference"))


_BLEU_T = r"""WITH b AS (SELECT item_id AS id, text AS p, CASE WHEN item_id % 2 = 0 THEN text ELSE coalesce(lead(text) OVER (ORDER BY item_id), text) END AS r FROM benchmark),
t AS (SELECT id, regexp_extract_all(lower(p), '[\w\p{L}\p{N}]+') AS p, regexp_extract_all(lower(r), '[\w\p{L}\p{N}]+') AS r FROM b)"""


def _grams(side):
    return f"(SELECT id, n, array_to_string({side}[i:i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT id, {side}, n, unnest(range(1, len({side}) - n + 2)) AS i FROM t, (VALUES (1), (2), (3), (4)) v(n)) GROUP BY ALL)"


@query(f"""{_BLEU_T}, m AS (SELECT n, sum(least(a.c, b.c)) AS c FROM {_grams('p')} a JOIN {_grams('r')} b USING (id, n, g) GROUP BY n),
s AS (SELECT n, sum(greatest(len(p) - n + 1, 0)) AS t FROM t, (VALUES (1), (2), (3), (4)) v(n) GROUP BY n),
l AS (SELECT sum(len(p)) AS np, sum(len(r)) AS nr FROM t)
SELECT round((SELECT CASE WHEN np >= nr THEN 1.0 ELSE exp(1 - nr / np) END FROM l) * exp(sum(ln(CASE WHEN coalesce(m.c, 0) = 0 THEN 1 / (t + 1) ELSE m.c / t END)) / 4), 6) AS bleu FROM s LEFT JOIN m USING (n)""")
def a_bleu(spark, sf):
    return evaluation.bleu(_pairs(spark, sf)).select(F.round("bleu", 6).alias("bleu"))


@query()
def a_rouge_l(spark, sf):
    return evaluation.rouge_l(_pairs(spark, sf))


@query("SELECT v.model, round((ppl - base) / greatest(base, 1e-6), 6) AS change, (ppl - base) / greatest(base, 1e-6) <= 0.02 AS passed FROM (SELECT label AS model, avg(abs(embedding[1])) AS ppl FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1) v JOIN (SELECT label AS model, avg(abs(embedding[1])) AS base FROM embeddings WHERE vec_id % 2 = 1 GROUP BY 1) b ON b.model = v.model")
def a_regression_gate(spark, sf):
    m = lambda r: table(spark, sf, "embeddings").filter(F.col("vec_id") % 2 == r).groupBy(F.col("label").alias("model")).agg(F.avg(F.abs(F.col("embedding")[0])).alias("perplexity"))
    return evaluation.regression_gate(m(0), m(1)).withColumn("change", F.round("change", 6))


@query("SELECT user_id AS model, event_id AS step, value AS loss FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3 OR row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1")
def g_keep_n(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("model"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return evaluation.keep_checkpoints(rows, 3, "loss")


@query("SELECT event_id, round(sqrt(value * value + 3) / (1 + abs(sin(value))), 6) AS result FROM events")
def calc(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(calculate("sqrt(value ** 2 + 3) / (1 + abs(sin(value)))", value=F.col("value")), 6).alias("result"))


def emb(spark, sf):
    return table(spark, sf, "embeddings")


def _query_vector(spark, sf):
    return [float(x) for x in emb(spark, sf).filter("vec_id = 0").first()["embedding"]]


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, e.vec_id LIMIT 3")
def v_topk(spark, sf):
    return vectors.top_k(emb(spark, sf), _query_vector(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_COS} >= 0.3 ORDER BY {_COS} DESC, e.vec_id LIMIT 5")
def v_topk_thr(spark, sf):
    return vectors.top_k(emb(spark, sf), _query_vector(spark, sf), 5, 0.3).withColumn("score", F.round("score", 6))


@query("SELECT item_id, contains(lower(text), 'the')::INT + contains(lower(text), 'sh')::INT + contains(lower(text), 'ering')::INT AS score FROM benchmark WHERE contains(lower(text), 'the') OR contains(lower(text), 'sh') OR contains(lower(text), 'ering') ORDER BY score DESC, encode(text) DESC LIMIT 5")
def v_keyword(spark, sf):
    return vectors.keyword_search(table(spark, sf, "benchmark"), "text", "the SH ering", 5).select("item_id", "score")


@query(r"WITH s AS (SELECT item_id, text, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\s+')), ['the', 'of', 'is']))::INT AS score FROM benchmark) SELECT item_id, score FROM s WHERE score > 0 ORDER BY score DESC, item_id LIMIT 5")
def v_keyword_set(spark, sf):
    return vectors.keyword_overlap(table(spark, sf, "benchmark"), "text", "the of is", 5, "item_id").select("item_id", "score")


@query("WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, (i - 1)::INT AS i, round(avg(x), 6) AS m FROM p GROUP BY 1, 2")
def mean_pool(spark, sf):
    return vectors.centroids_of(emb(spark, sf), "label").select("label", F.posexplode("centroid").alias("i", "m")).withColumn("m", F.round("m", 6))


_UNNEST = "SELECT vec_id, generate_subscripts(x, 1) - 1 AS i, round(unnest(x), 5) AS x FROM"


@query(f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda y: y::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE))), 1e-12)) AS x FROM embeddings) {_UNNEST} v")
def emb_l2norm(spark, sf):
    """Every component of every unit vector."""
    return emb(spark, sf).select("vec_id", F.posexplode(vectors.l2_normalised(F.col("embedding"))).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


@query()
def emb_base64(spark, sf):
    return emb(spark, sf).select("vec_id", vectors.base64_of(F.col("embedding")).alias("data"))


@query("""WITH c AS (SELECT label, embedding AS c FROM embeddings WHERE vec_id < 5), d AS (SELECT e.vec_id, k.r, list_sum(list_transform(list_zip(e.embedding, k.c), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM embeddings e, (SELECT vec_id AS r, embedding AS c FROM embeddings WHERE vec_id < 5) k)
SELECT vec_id, r::INT AS cluster FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, r) = 1""")
def v_kmeans_assign(spark, sf):
    centres = [list(r["embedding"]) for r in emb(spark, sf).filter("vec_id < 5").orderBy("vec_id").collect()]
    return vectors.assign(emb(spark, sf), centres)


@query()
def v_kmeans(spark, sf):
    return vectors.kmeans(emb(spark, sf), 5)[0]


@query("""WITH p AS (SELECT event_id AS k, (epoch_ms(ts) / 3600000.0)::DOUBLE AS x, value AS y FROM events),
n AS (SELECT a.k, b.k AS j FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4.0),
c AS (SELECT k FROM n GROUP BY k HAVING count(*) >= 4) SELECT p.k AS id, p.k IN (SELECT k FROM c) AS core, p.k NOT IN (SELECT n.k FROM n JOIN c ON c.k = n.j) AS noise FROM p""")
def v_dbscan(spark, sf):
    """Core and noise points; cluster names are tested apart."""
    p = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.array(millis(F.col("ts")) / 3600000.0, F.col("value")).alias("v"))
    return vectors.clustered(p, 2.0, 4, "id", "v").select("id", "core", (F.col("cluster") == -1).alias("noise"))


@query()
def v_agglo(spark, sf):
    return vectors.agglomerative(emb(spark, sf), 5)


@query()
def v_pca(spark, sf):
    return vectors.project(emb(spark, sf), vectors.pca(emb(spark, sf), 2))


@query("""WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), s AS (SELECT count(*) + 1e-4 AS n, sum(x) AS sx, sum(x * x) + 1e-4 AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM t)
SELECT round((sxx * sy - sx * sxy) / (n * sxx - sx * sx), 2) AS intercept, round((n * sxy - sx * sy) / (n * sxx - sx * sx), 2) AS slope FROM s""")
def v_ols(spark, sf):
    b = vectors.ols(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(float(b[0]), float(b[1]))], "intercept double, slope double").select(F.round("intercept", 2).alias("intercept"), F.round("slope", 2).alias("slope"))


@query("""WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), s AS (SELECT count(*) + 1e-4 AS n, sum(x) AS sx, sum(x * x) + 1e-4 AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM t),
c AS (SELECT (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS a, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM s), m AS (SELECT avg(y) AS m FROM t)
SELECT round(1 - sum((y - a - b * x) * (y - a - b * x)) / (sum((y - m) * (y - m)) + 1e-10), 6) AS r2 FROM t, c, m""")
def a_r2(spark, sf):
    t = table(spark, sf, "lineitem")
    b = vectors.ols(t, ["l_quantity"], "l_extendedprice")
    return evaluation.r2(t.select(F.col("l_extendedprice").alias("y"), vectors.predicted(b, ["l_quantity"]).alias("pred"))).select(F.round("r2", 6).alias("r2"))


@query()
def v_poly(spark, sf):
    t = vectors.polynomial(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", 3)
    b = vectors.ols(t, ["l_quantity_1", "l_quantity_2", "l_quantity_3"], "l_extendedprice")
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "power int, coefficient double")


@query()
def v_viterbi(spark, sf):
    e = emb(spark, sf).select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(F.col("embedding"), i * 4 + 1, 4).cast("array<double>")).alias("emissions"))
    return vectors.viterbi(e, [0.0] * 4, [[0.1 if i == j else -0.1 for j in range(4)] for i in range(4)])


@query()
def w_gae(spark, sf):
    s = table(spark, sf, "events").select(F.col("user_id").alias("episode"), F.col("event_id").alias("t"), F.col("value").alias("reward"), F.lit(0.5).alias("value"), F.lit(0.5).alias("next_value"), (F.col("event_type") == "purchase").alias("done"))
    return vectors.gae(s)


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT doc_id, len(w) AS n, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM w)
SELECT doc_id, n::INT AS n, round(CASE WHEN len(g) > 0 THEN 1 - len(list_distinct(g)) / len(g) ELSE 0.0 END, 6) AS repeated FROM b""")
def reward_shape(spark, sf):
    """Share of repeated bigrams, the penalty of reward shaping."""
    from quern.functions.text import words

    w = table(spark, sf, "documents").select("doc_id", words(F.col("text")).alias("w"))
    g = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))).otherwise(F.array().cast("array<string>"))
    return w.select("doc_id", F.size("w").alias("n"), F.round(F.when(F.size(g) > 0, 1 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(0.0), 6).alias("repeated"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT doc_id, len(w) AS n, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM w)
SELECT b.doc_id, round(l.quality + CASE WHEN n BETWEEN 50 AND 300 THEN 0.5 WHEN n < 50 THEN 0.5 * n / 50 - 0.5 ELSE -0.5 * (n - 300) / 300 END - CASE WHEN n > 2 THEN 0.3 * (len(g) - len(list_distinct(g))) / greatest(n - 1, 1) ELSE 0 END, 6) AS reward
FROM b JOIN labels l ON l.doc_id = b.doc_id""")
def reward_length(spark, sf):
    """The quality label as a reward, with the bonus for a length between 50 and 300 words and the penalty for repetition."""
    from quern.functions.text import words

    d = table(spark, sf, "documents").select("doc_id", words(F.col("text")).alias("w")).join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", F.round(evaluation.shaped_reward(F.col("quality"), F.col("w"), 50, 300, 0.5, 0.3), 6).alias("reward"))


@query()
def corpus_build(spark, sf):
    """The whole page pipeline: extraction, exact and near dedup, quality with the language rule last; stage counts."""
    from quern.operators import language
    from quern.plans import corpus_build as build
    from quern.plans.lineage import folder

    languages = language.detector(language.profiles(spread(table(spark, sf, "documents"))))
    tables = build.build(table(spark, sf, "pages").select("url", "html"), folder(spark, "corpus"), languages=languages)
    return build.stats(tables)
