"""Gates of a release folder: its files, its state, its weights and its vocabulary.

A release holds train_state.json, tokenizer/vocab.json and tokenizer/tokenizer_config.json, and weights as Parquet: a row for
each tensor row, with the tensor's name, the row's number and its values. Weights are read by Spark, however many there are.
"""

from __future__ import annotations

import json

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.files import read_small

FILES = ("train_state.json", "tokenizer/vocab.json", "tokenizer/tokenizer_config.json", "weights")


def tensors(weights: DataFrame) -> DataFrame:
    """tensor, rows, same_size and broken (values that are null, NaN or infinite) of weights(tensor, row, values)."""
    bad = F.size(F.filter("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = [F.count("*").alias("rows"), (F.min(F.size("values")) == F.max(F.size("values"))).alias("same_size"), F.sum(bad).alias("broken")]
    return weights.groupBy("tensor").agg(*sizes)


def release(spark: SparkSession, folder: str, embedding: str = "embedding") -> DataFrame:
    """check, passed and detail of a release folder; what rests on a file that is missing fails, too."""
    rows: list[tuple[str, bool, str]] = []

    def found(path: str) -> bool:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{path}")
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    missing = [x for x in FILES if not found(x)]
    rows.append(("files", not missing, ", ".join(missing)))

    def parsed(path: str) -> dict | None:
        try:
            return json.loads(read_small(spark, f"{folder}/{path}"))  # Infinity and NaN are numbers to this parser
        except (PySparkException, ValueError):
            return None

    state = parsed("train_state.json") if "train_state.json" not in missing else None
    rows.append(("state", isinstance(state, dict), "" if state is None else f"step {state.get('global_step')}"))
    vocabulary, config = (parsed(x) if x not in missing else None for x in FILES[1:3])
    ids = sorted(vocabulary.values()) if isinstance(vocabulary, dict) else []
    rows.append(("vocabulary", bool(ids) and ids == list(range(len(ids))) and (config or {}).get("vocab_size") == len(ids), f"{len(ids)} tokens"))
    found_rows = None
    if "weights" in missing:
        rows.append(("weights", False, ""))
    else:
        seen = tensors(spark.read.parquet(f"{folder}/weights"))
        total, bad = seen.agg(F.count("*"), F.count_if((F.col("broken") > 0) | ~F.col("same_size"))).first()
        found_rows = seen.filter(F.col("tensor") == embedding).agg(F.max("rows")).first()[0]
        rows.append(("weights", total > 0 and bad == 0, f"{bad} of {total} tensors are broken"))
    rows.append(("match", bool(ids) and found_rows == len(ids), f"{found_rows} rows, {len(ids)} tokens"))
    return spark.createDataFrame(rows, "check string, passed boolean, detail string")
