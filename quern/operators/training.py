"""Training sets from token arrays and chat turns: fixed length, packing, causal and masked language modelling, chat."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from quern.functions.text import strip
from quern.operators.corpus import before, ranks
from quern.operators.tokenizers import ASSISTANT, END_TURN, EOS, MASK, PAD, SPECIALS, BpeWords, Tokenizer, encode
from quern.plans.lineage import written
from quern.session import ship

IGNORED = -100
#: Makes key and ids of rows, one row for each, in their places.
Ids = Callable[[DataFrame], DataFrame]
DEFAULT_SYSTEM = "You are a helpful assistant."


def fixed(ids: Column, length: int) -> Column:
    """input_ids, attention_mask and labels (padding ignored) of exactly length."""
    padded = F.slice(F.concat(ids, F.array_repeat(F.lit(PAD), length)), 1, length)
    mask = F.slice(F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), length)), 1, length)
    labels = F.transform(padded, lambda t: F.when(t == PAD, IGNORED).otherwise(t))
    return F.struct(padded.alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels"))


def _padded(rows: DataFrame, key: str, batch: int, left: bool, ids: Ids | None) -> DataFrame:
    """key, batch, input_ids and n (ids without padding) of rows(key, ids) in batches of consecutive rows. With a function that
    makes ids of rows(key, ...) in their places, the rows are numbered and dealt without ids, which are not shuffled."""
    numbered = ranks(rows, [key], "__q_r").withColumn("batch", F.floor((F.col("__q_r") - 1) / batch))
    name = F.struct(F.col(key).alias("key"), "batch").alias(key)
    met = numbered.repartition("batch").sortWithinPartitions("batch", "__q_r").select(name, *[f"`{c}`" for c in rows.columns if c != key])
    met = (ids(met) if ids else met).select(f"`{key}`.key", f"`{key}`.batch", "ids")
    kind = rows.schema[key].dataType

    def each(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Scalar, int, np.ndarray | None]] = []

        def made() -> Iterator[pa.RecordBatch]:
            longest = max((len(x) for *_, x in held if x is not None), default=0)
            step = max(1, AT_ONCE // max(1, longest))
            for at in range(0, len(held), step):
                some = held[at : at + step]
                sizes = np.array([-1 if x is None else len(x) for *_, x in some], np.int64)
                flat = np.full((int((sizes >= 0).sum()), longest), PAD, np.int32)
                for row, x in zip(flat, (x for *_, x in some if x is not None), strict=True):
                    row[longest - len(x) if left else 0 : longest if left else len(x)] = x
                ends = np.concatenate([[0], np.cumsum((sizes >= 0) * longest)])
                offsets = pa.array(ends.astype(np.int32), mask=np.append(sizes < 0, False))
                keys = pa.concat_arrays([k for k, *_ in some])
                yield pa.RecordBatch.from_arrays([keys, pa.array([b for _, b, _ in some], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel())), pa.array(sizes, pa.int32(), mask=sizes < 0)], ["key", "batch", "input_ids", "n"])

        for found_batch in found:
            keys, numbers, lists = found_batch.columns
            flat, at, there = _flat(lists)
            for i, b in enumerate(numbers.to_pylist()):
                if held and held[0][1] != b:
                    yield from made()
                    held.clear()
                held.append((keys.slice(i, 1), b, flat[at[i] : at[i + 1]] if there[i] else None))
        if held:
            yield from made()

    schema = StructType([StructField("key", kind), StructField("batch", LongType()), StructField("input_ids", ArrayType(IntegerType())), StructField("n", IntegerType())])
    return met.mapInArrow(each, schema).withColumnRenamed("key", key)


#: Ids of a padded batch that are made at once.
AT_ONCE = 1 << 18


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elements of lists of numbers (null: 0), where each list begins there and the last ends, and which lists aren't null."""
    flat = lists.flatten()
    flat = (flat.fill_null(0) if flat.null_count else flat).to_numpy()
    sizes = lists.value_lengths()
    sizes = (sizes.fill_null(0) if sizes.null_count else sizes).to_numpy()
    return flat, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), np.asarray(lists.is_valid())


def dynamic_pad(rows: DataFrame, key: str, batch: int, left: bool = False, ids: Ids | None = None) -> DataFrame:
    """rows(key, ids) in batches of consecutive rows, padded to the longest of each batch. ids: a function that makes them of
    rows(key, ...)."""
    return _padded(rows, key, batch, left, ids).drop("n")


def batches(rows: DataFrame, key: str, batch: int, ids: Ids | None = None) -> DataFrame:
    """rows(key, ids) in batches of consecutive rows: input_ids padded to the longest of the batch, and their masks."""
    return _padded(rows, key, batch, False, ids).select(key, "batch", "input_ids", F.transform("input_ids", lambda _, i: (i < F.col("n")).cast("int")).alias("attention_mask"))


def _placed(docs: DataFrame, key: str, end: int | None, ids: Ids | None) -> DataFrame:
    """ids and first: the documents' tokens without padding, each document followed by end, and the number of tokens before
    it, by key. Stored in that order. With a function that makes ids of docs(key, ...) in their places, it is the documents
    that are sorted: sampling and sorting them makes no ids. Sums run in sorted partitions and are shifted by their totals."""
    ship(docs.sparkSession)
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() != "map"]
    ordered = docs.sort(key, F.xxhash64(*plain))

    def each(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in found:
            flat, at, there = _flat(batch.column(0))
            kept = flat != PAD
            sizes = np.diff(np.concatenate([[0], np.cumsum(kept)])[at])
            flat = flat[kept]
            if end is not None:
                flat = np.insert(flat, np.cumsum(sizes)[there], end)
                sizes += there
            ends = np.concatenate([[0], np.cumsum(sizes)])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, pa.array(total + ends[:-1]), pa.array(sizes), pa.array(np.full(len(sizes), part, np.int32))], ["ids", "first", "n", "__q_p"])
            total += int(ends[-1])

    rows = (ids(ordered) if ids else ordered).select("ids").mapInArrow(each, "ids array<int>, first long, n long, __q_p int")
    stored = written(rows.filter("n > 0"), "sorted")
    totals = [(r["__q_p"], r["n"]) for r in stored.groupBy("__q_p").agg(F.sum("n").alias("n")).collect()]  # one row a partition
    return stored.select("ids", (F.col("first") + before(totals)).alias("first"))


def _pieces(docs: DataFrame, key: str, end: int | None, block: int, beyond: int = 0, ids: Ids | None = None) -> DataFrame:
    """block_id and x: the documents' tokens, by key, each document followed by end, in blocks that hold ``beyond`` tokens
    of the next one besides. Consecutive documents of a batch are cut as one; only blocks over a batch's edge meet by number."""
    placed = _placed(docs, key, end, ids)
    full = block + beyond

    def cut(whole: bool):
        def each(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                flat, at, _ = _flat(batch.column(0))
                first = batch.column(1).to_numpy()
                breaks = np.flatnonzero(first[1:] != first[:-1] + np.diff(at)[:-1]) + 1
                for i, j in zip([0, *breaks.tolist()], [*breaks.tolist(), len(first)], strict=True):
                    if i == j:
                        continue
                    run, start = flat[at[i] : at[j]], int(first[i])
                    # The block that a run begins in, and for its sake the one before, of which it may hold the tokens beyond.
                    low, high = max(start - beyond, 0) // block, (start + len(run) - 1) // block
                    inner = range(-(-start // block), (start + len(run) - full) // block + 1)
                    if whole:
                        for k in range(inner.start, inner.stop, step := max(1, AT_ONCE // full)):
                            some = np.arange(k, min(k + step, inner.stop))
                            x = run[(some * block - start)[:, None] + np.arange(full)].ravel()
                            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, full, dtype=np.int32)), pa.array(x))
                            yield pa.RecordBatch.from_arrays([pa.array(some), lists], ["block_id", "x"])
                        continue
                    rest = [k for k in (range(low, high + 1) if not len(inner) else [*range(low, inner.start), *range(inner.stop, high + 1)])]
                    spans = [(k, max(k * block, start), min(k * block + full, start + len(run))) for k in rest]
                    spans = [(k, a, b) for k, a, b in spans if a < b]
                    if spans:
                        x = pa.array([run[a - start : b - start] for _, a, b in spans], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in spans], pa.int64()), pa.array([a for _, a, _ in spans], pa.int64()), x], ["block_id", "at", "x"])

        return each

    inside = placed.mapInArrow(cut(True), "block_id long, x array<int>")
    edges = placed.mapInArrow(cut(False), "block_id long, at long, x array<int>").select("block_id", F.struct("at", "x").alias("p"))
    met = edges.groupBy("block_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return inside.union(met.select("block_id", F.flatten(F.transform("p", lambda p: p["x"]))))


def pack(docs: DataFrame, block: int, key: str = "doc_id", end: int = EOS, ids: Ids | None = None) -> DataFrame:
    """block_id and input_ids: full blocks of the joined documents; an incomplete last block is left out. ids: a function
    that makes them of docs(key, ...), a row for each in its place."""
    return _pieces(docs, key, end, block, ids=ids).filter(F.size("x") == block).select("block_id", F.col("x").alias("input_ids"))


def causal(docs: DataFrame, block: int, key: str = "doc_id", end: int = EOS, ids: Ids | None = None) -> DataFrame:
    """block_id, input_ids and labels (the next token; ignored where the input ends a document)."""
    # A block counts if a token follows it, its last label.
    x = _pieces(docs, key, end, block, 1, ids).filter(F.size("x") == block + 1)
    tokens = F.slice("x", 1, block)
    return x.select("block_id", tokens.alias("input_ids"), F.zip_with(tokens, F.slice("x", 2, block), lambda t, following: F.when(t == end, IGNORED).otherwise(following)).alias("labels"))


_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hashed(seeds: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """``F.xxhash64(..., number)`` of hashes of what stands before, for numbers from 0 of 32 bits."""
    turned = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    with np.errstate(over="ignore"):
        h = seeds + (_P5 + np.uint64(4)) ^ np.asarray(number).astype(np.uint64) * _P1
        h = turned(h, 23) * _P2 + _P3
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def masked(docs: DataFrame, vocabulary: int, key: str = "doc_id", share: float = 0.15, seed: int = 7) -> DataFrame:
    """key, input_ids and labels: max(1, share) of the positions without specials; of these 80 % <mask>, 10 % random, 10 % kept.

    Positions and replacements come from hashes of key and position, so a rerun masks alike; they are made in tasks as arrays.
    """
    ship(docs.sparkSession)

    def some(keys: pa.Array, lists: pa.ListArray, name: np.ndarray) -> pa.RecordBatch:
        flat, at, there = _flat(lists)
        sizes = np.diff(at)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.flatnonzero(flat > 11)
        named = _hashed(name[row[place]], place - at[row[place]])
        named = _hashed(named, seed)
        h = lambda i, salt: (_hashed(named[i], salt) & np.uint64((1 << 30) - 1)).astype(np.int64)
        # Of each row the places of least hash, of equal ones the first.
        order = np.argsort(row[place] << 30 | h(slice(None), 1), kind="stable")
        n = np.bincount(row[place], minlength=len(sizes))
        most = np.maximum(1, np.floor(n * share).astype(np.int64))
        of = row[place[order]]
        chosen = order[np.arange(len(order)) - (np.cumsum(n) - n)[of] < most[of]]
        labels = np.full(len(flat), IGNORED, np.int32)
        labels[place[chosen]] = flat[place[chosen]]
        kind = h(chosen, 2) % 10
        new = flat.astype(np.int32)
        new[place[chosen[kind < 8]]] = MASK
        other = chosen[kind == 8]
        new[place[other]] = 12 + h(other, 3) % max(1, vocabulary - 12)
        offsets = pa.array(at.astype(np.int32), mask=np.append(~there, False))
        gone = lists.flatten().is_null().to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(new, mask=gone)), pa.ListArray.from_arrays(offsets, pa.array(labels))], [key, "input_ids", "labels"])

    def each(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield some(part.column(0), part.column(1), part.column(2).to_numpy().view(np.uint64))

    schema = StructType([docs.schema[key], *(StructField(c, ArrayType(IntegerType())) for c in ("input_ids", "labels"))])
    return docs.select(key, "ids", F.xxhash64(key).alias("__q_h")).mapInArrow(each, schema)


def chat_text(turns: DataFrame, system: str = DEFAULT_SYSTEM, end: bool = True) -> DataFrame:
    """conv_id and text: delimited turns, stripped, in order; the first system turn leads (else the default), other roles are left out."""
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", strip(F.col("text")).alias("text")))).alias("t"))
    own = F.transform(F.filter("t", lambda m: m["role"] == "system"), lambda m: m["text"])
    head = F.concat(F.lit("<|system|>\n"), F.coalesce(F.try_element_at(own, F.lit(1)), F.lit(system)), F.lit("\n"))
    one = lambda m: F.when(m["role"] == "user", F.concat(F.lit("<|user|>\n"), m["text"], F.lit("\n"))).when(m["role"] == "assistant", F.concat(F.lit("<|assistant|>\n"), m["text"], F.lit("\n<|end_turn|>\n"))).otherwise("")
    return lists.select("conv_id", F.concat(head, F.array_join(F.transform("t", one), ""), F.lit("<eos>" if end else "")).alias("text"))


def instruction_text(instruction: Column, given: Column, response: Column, end: bool = True) -> Column:
    middle = F.when(F.length(F.coalesce(given, F.lit(""))) > 0, F.concat(F.lit("\n### Input:\n"), given)).otherwise("")
    return F.concat(F.lit("### Instruction:\n"), instruction, middle, F.lit("\n### Response:\n"), response, F.lit("<eos>" if end else ""))


def response_mask(ids: Column, opens: int, closes: int) -> Column:
    """True inside responses: after an opening id, up to a closing one; the delimiters themselves are not."""
    # The last delimiter before each place, by a running maximum of their places: odd for an opening one.
    marks = F.transform(ids, lambda t, i: F.when(t == opens, 2 * i + 3).when(t == closes, 2 * i + 2).otherwise(0))

    @F.pandas_udf("array<boolean>")
    def inside(s: pd.Series) -> pd.Series:
        return s.map(lambda m: None if m is None else (np.maximum.accumulate(m) % 2 == 1) & (m == 0) if len(m) else [])

    return inside(marks)


def marked_words(text: Column, words) -> Column:
    """The words of text by a column function, the delimiters of chats and the end as words of their own."""
    marks = r"<\|system\|>|<\|user\|>|<\|assistant\|>|<\|end_turn\|>|<eos>"
    parts = F.filter(F.split(text, f"(?={marks})|(?<={marks})", -1), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.when(p.rlike(f"^(?:{marks})$"), F.array(p)).otherwise(words(p))))


def marked_ids(texts: DataFrame, tokenizer: Tokenizer, key: str) -> DataFrame:
    """key and ids of texts(key, text), with delimiters as their own ids."""
    marks, encode_word = frozenset(SPECIALS), tokenizer.encode_word()
    each = BpeWords(tokenizer.merges, marks) if tokenizer.merges is not None else lambda w: [w] if w in marks else encode_word(w)
    return encode(texts.select(key, "text"), marked_words(F.col("text"), tokenizer.words), each, tokenizer.vocabulary, key)


def padded(ids: Column, length: int, fill: int = PAD) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill), length - F.size(ids)))


def chat_ids(turns: DataFrame, tokenizer: Tokenizer, longest: int = 2048, least: int = 4) -> DataFrame:
    """conv_id, input_ids, attention_mask and labels, each of exactly longest, of conversations in chat form with at least so
    many ids. A place inside a response is labelled with the id that follows it, all others are ignored."""
    ids = marked_ids(chat_text(turns), tokenizer, "conv_id").filter(F.size("ids") >= least).select("conv_id", F.slice("ids", 1, longest).alias("ids"))
    following = F.concat(F.slice("ids", 2, longest), F.array(F.when(F.size("ids") == longest, EOS).otherwise(PAD)))
    labels = F.zip_with(following, response_mask(F.col("ids"), ASSISTANT, END_TURN), lambda t, said: F.when(said, t).otherwise(IGNORED))
    ones = F.transform("ids", lambda _: F.lit(1))
    return ids.select("conv_id", padded(F.col("ids"), longest).alias("input_ids"), padded(ones, longest, 0).alias("attention_mask"), padded(labels, longest, IGNORED).alias("labels"))


def preference_ids(pairs: DataFrame, tokenizer: Tokenizer, longest: int = 512, least: int = 2) -> DataFrame:
    """input_ids and attention_mask of both sides of pairs(prompt, chosen, rejected, ...), each of exactly longest, beside the
    pairs' other columns. Incomplete pairs and those with a side of less than so many ids are left out."""
    others = [c for c in pairs.columns if c not in ("prompt", "chosen", "rejected")]
    whole = preference_pairs(pairs)
    text = lambda side: F.concat(strip(F.col("prompt")), F.lit("\n"), strip(F.col(side)), F.lit("<eos>"))
    name = F.struct(*others, F.xxhash64("prompt", "chosen", "rejected").alias("__q_h"))
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), text(side).alias("text")) for i, side in enumerate(("chosen", "rejected"))]))
    rows = whole.select(name.alias("pair"), sides.alias("x")).select(F.struct("pair", F.col("x.side").alias("side")).alias("key"), "x.text")
    ids = marked_ids(rows, tokenizer, "key")
    side = lambda i: F.max(F.when(F.col("key.side") == i, F.col("ids")))
    both = ids.groupBy(F.col("key.pair").alias("pair")).agg(side(0).alias("chosen"), side(1).alias("rejected"), F.count_if(F.col("key.side") == 0).cast("int").alias("copies"))
    both = both.filter((F.size("chosen") >= least) & (F.size("rejected") >= least))
    cut = lambda c: F.slice(c, 1, longest)
    columns = [x for c in ("chosen", "rejected") for x in (padded(cut(c), longest).alias(f"{c}_input_ids"), padded(F.transform(cut(c), lambda _: F.lit(1)), longest, 0).alias(f"{c}_attention_mask"))]
    return both.select("pair", *columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*[F.col(f"pair.{c}").alias(c) for c in others], *[f"{c}_{k}" for c in ("chosen", "rejected") for k in ("input_ids", "attention_mask")])


def budget_tail(turns: DataFrame, budget: int) -> DataFrame:
    """The newest turns whose estimated tokens fit beside the system turns, which always stay."""
    from quern.functions.text import estimated_tokens

    t = turns.withColumn("__q_n", estimated_tokens(F.col("text")))
    used = t.filter("role = 'system'").groupBy("conv_id").agg(F.sum("__q_n").alias("__q_used"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    rest = t.filter("role <> 'system'").withColumn("__q_sum", F.sum("__q_n").over(w)).join(used, "conv_id", "left")
    kept = rest.filter(F.col("__q_sum") <= budget - F.coalesce("__q_used", F.lit(0))).select(*turns.columns)
    return kept.unionByName(turns.filter("role = 'system'"))


def budget_head(turns: DataFrame, budget: int) -> DataFrame:
    """Turns in order, each kept if it still fits after those kept before it: an ordered fold per conversation."""
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.greatest(F.lit(1), F.floor(F.length("text") / 4).cast("int")).alias("n")))).alias("t"))
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda s, m: F.when(s["sum"] + m["n"] <= budget, F.struct((s["sum"] + m["n"]).alias("sum"), F.concat(s["kept"], F.array(m["turn"])).alias("kept"))).otherwise(s)
    return lists.select("conv_id", F.explode(F.aggregate("t", start, step)["kept"]).alias("turn"))


def preference_pairs(df: DataFrame) -> DataFrame:
    """prompt, chosen and rejected, without incomplete rows."""
    ok = [F.length(F.coalesce(c, F.lit(""))) > 0 for c in ("prompt", "chosen", "rejected")]
    return df.filter(ok[0] & ok[1] & ok[2])


#: What prompts add to the system text or begin the answer with.
STEP_BY_STEP, FIRST_STEP = " Think step by step.", "Let me think through this step by step.\n\n"
CODE_SYSTEM = "You are an expert software engineer. Write clean, correct, and well-commented code. Follow best practices for the requested language. Only output code and brief explanations, no unnecessary prose."


def _said(role: str, text: Column) -> Column:
    return F.concat(F.lit(f"<|{role}|>\n"), text, F.lit("\n"))


def prompt(name: str, user: Column, system: Column | None = None, history: Column | None = None, language: str = "Python") -> Column:
    """A prompt up to where the assistant answers, in one of five forms: system, chat, few_shot, cot and code.

    history: earlier turns, array<struct<user, assistant>>, of chat and few_shot.
    """
    if name not in ("system", "chat", "few_shot", "cot", "code"):
        raise ValueError(f"no prompt form {name}")
    head = F.lit(DEFAULT_SYSTEM) if system is None else system
    if name == "cot":
        head = F.concat(head, F.lit(STEP_BY_STEP))
    if name == "code" and system is None:
        head = F.lit(f"{CODE_SYSTEM} Language: {language}.")
    turn = lambda x: F.concat(_said("user", x["user"]), _said("assistant", x["assistant"]), F.lit("<|end_turn|>\n"))
    before = F.array_join(F.transform(history, turn), "") if history is not None and name in ("chat", "few_shot") else F.lit("")
    opening = {"cot": FIRST_STEP, "code": f"```{language.lower()}\n"}.get(name, "")
    return F.concat(_said("system", head), before, _said("user", user), F.lit("<|assistant|>\n" + opening))
