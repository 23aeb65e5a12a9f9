"""Token counts: pieces are counted once per distinct pre-token and joined to the documents' pre-token frequencies.

Frequent pre-tokens (the head, by powers of two of their counts, of at most ``head_bytes`` together) travel to the
tasks as one Arrow table; all others (the tail) are joined by shuffle. The head's size is measured before it is sent,
so nothing that is broadcast grows with the corpus. No ids are kept anywhere.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows each keep a row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import buffer_of, strings
from quern.llm.pretoken import pretokens
from quern.plans.lineage import written
from quern.session import ship

#: Bytes that the broadcast head may take, at 16 a pre-token besides its own.
HEAD_BYTES = 16 << 20


@cache
def tokenizer(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


@cache
def special_of(path: str) -> str:
    """The text of the file's only special token."""
    specials = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    if len(specials) > 1:
        raise ValueError("files with more than one added token are not handled")
    return specials[0] if specials else ""


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    special = special_of(tokenizer_path)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _ = pretokens(batch.column(1), special)
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n, pa.int64())], ["piece", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(tokenizer_path)
        for batch in batches:
            sizes = [len(x) for x in t.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["piece", "n", "pieces"])

    vocabulary = docs.mapInArrow(distinct, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counted = written(vocabulary.mapInArrow(count, "piece string, n long, pieces long"), "pieces")
    level = F.floor(F.log2("n")).cast("int")
    levels = counted.groupBy(level.alias("level")).agg(F.sum(F.octet_length("piece") + 16).alias("bytes")).collect()
    least, total = 64, 0
    for row in sorted(levels, key=lambda r: -r["level"]):
        total += row["bytes"]
        if total > head_bytes:
            break
        least = row["level"]
    head = counted.filter(level >= least).select("piece", F.col("pieces").cast("int").alias("pieces")).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema) as out:
        out.write_table(head)
    sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.ipc.open_stream(sent.value).read_all().combine_chunks()
        keys, sizes = known.column(0).cast(pa.string()), np.append(known.column(1).to_numpy(), 0).astype(np.int64)
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        part, row = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            words, counts = pretokens(batch.column(1), special)
            m, at = len(counts), words.indices.to_numpy()
            found = pc.index_in(words.dictionary, value_set=keys).to_numpy(zero_copy_only=False) if len(words.dictionary) else np.empty(0)
            unknown = np.isnan(found) if found.dtype.kind == "f" else np.zeros(len(found), bool)
            size = sizes[np.where(unknown, len(sizes) - 1, found).astype(np.int64)]
            owner = np.repeat(np.arange(m, dtype=np.int64), counts)
            heads = np.bincount(owner, weights=size[at], minlength=m).astype(np.int64)
            rare = unknown[at]
            pairs, often = np.unique(owner[rare] << 32 | at[rare], return_counts=True)
            rids = part + row + np.arange(m, dtype=np.int64)
            _, offsets = buffer_of(strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids), batch.column(0).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array([f"\x00{r}" for r in rids], pa.string()), pa.array(heads), pa.array(np.ones(m, bool))],
                names,
            )
            if len(pairs):
                none = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rids[pairs >> 32]), none, none, words.dictionary.take(pa.array(pairs & 0xFFFFFFFF)), pa.array(often.astype(np.int64)), pa.array(np.zeros(len(pairs), bool))], names)
            row += m

    names = ["rid", "doc_id", "n_bytes", "piece", "n", "own"]
    rows = docs.mapInArrow(frequencies, "rid long, doc_id long, n_bytes long, piece string, n long, own boolean")
    tail = counted.filter(level < least).select("piece", "pieces")
    each = F.when(F.col("own"), F.col("n")).otherwise(F.col("n") * F.col("pieces"))
    return (
        rows.join(tail, "piece", "left")
        .groupBy("rid")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(each).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
