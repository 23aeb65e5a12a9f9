"""Contrastive loss over pairs of views, by blocks of similarities, none of which is kept.

Two views of each pair are normalised; each view's other one is its positive, all other views of its batch are negatives.
Similarities lie between -1 and 1, so sums of exp((s - 1) / temperature) can't overflow and add up over blocks: a block of
rows meets a block of rows in one task, which yields a sum a row. A batch may be as large as the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.lineage import written
from quern.session import ship

TEMPERATURE, BLOCK = 0.5, 2_048


def views(pairs: DataFrame) -> DataFrame:
    """batch, pair, side and z (normalised) of pairs(batch, pair, a, b); pairs with a null or zero view are left out."""
    ship(pairs.sparkSession)

    def unit(v) -> np.ndarray | None:
        x = np.asarray(v, float) if v is not None else np.zeros(0)
        n = np.sqrt((x * x).sum())
        return x / n if n > 0 and np.isfinite(n) else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b, p, *both in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                z = [unit(v) for v in both]
                if all(v is not None for v in z):
                    rows += [(b, p, side, z[side].tolist()) for side in (0, 1)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["batch", "pair", "side", "z"])

    return pairs.select(F.col("batch").cast("long"), F.col("pair").cast("long"), "a", "b").mapInArrow(each, "batch long, pair long, side int, z array<double>")


def nt_xent(pairs: DataFrame, temperature: float = TEMPERATURE, block: int = BLOCK) -> DataFrame:
    """batch, pair, side and loss of each view: minus the log of its positive's share among all other views of its batch.
    Pairs are numbered uniquely in their batch."""
    z = views(pairs)
    counts = z.groupBy("batch").agg(F.count("*").alias("n")).select("batch", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = z.join(counts, "batch").withColumn("i", F.pmod(F.xxhash64("pair"), F.col("blocks")).cast("int"))
    placed = written(placed, "views")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left, right = placed.withColumn("j", others), placed.withColumnRenamed("i", "j").withColumn("i", others)

    def each(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"batch": [], "pair": [], "side": [], "total": [], "positive": []})
        x, y = np.stack(a["z"]), np.stack(b["z"])
        total, positive = np.zeros(len(a)), np.full(len(a), np.nan)
        pair, side = b["pair"].to_numpy(), b["side"].to_numpy()
        for at in range(0, len(a), 512):
            s = (x[at : at + 512] @ y.T - 1) / temperature
            same = a["pair"].to_numpy()[at : at + 512, None] == pair
            own = same & (a["side"].to_numpy()[at : at + 512, None] == side)
            total[at : at + 512] = np.where(own, 0.0, np.exp(s)).sum(1)
            rows, to = np.nonzero(same & ~own)
            positive[at + rows] = s[rows, to]
        return pd.DataFrame({"batch": a["batch"], "pair": a["pair"], "side": a["side"], "total": total, "positive": positive})

    keys = ["batch", "i", "j"]
    sums = left.select(*keys, "pair", "side", "z").groupBy(*keys).cogroup(right.select(*keys, "pair", "side", "z").groupBy(*keys)).applyInPandas(each, "batch long, pair long, side int, total double, positive double")
    merged = sums.groupBy("batch", "pair", "side").agg(F.sum("total").alias("total"), F.max(F.when(~F.isnan("positive"), F.col("positive"))).alias("positive"))
    return merged.select("batch", "pair", "side", (F.ln("total") - F.col("positive")).alias("loss"))
