"""Evaluation metrics over prediction tables, and the gates that read them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import ship

IGNORED = -100


def accuracy(rows: DataFrame) -> DataFrame:
    """Share of pred = label among rows whose label counts."""
    return rows.filter(F.col("label") != IGNORED).agg(F.coalesce(F.avg((F.col("pred") == F.col("label")).cast("int")), F.lit(0.0)).alias("accuracy"))


def top_k_accuracy(rows: DataFrame, k: int) -> DataFrame:
    """rows(ranked array, label)."""
    return rows.filter(F.col("label") != IGNORED).agg(F.coalesce(F.avg(F.array_contains(F.slice("ranked", 1, k), F.col("label")).cast("int")), F.lit(0.0)).alias("accuracy"))


def perplexity(rows: DataFrame, cap: float = 100.0) -> DataFrame:
    """exp of the mean negative log-likelihood of rows(nll, tokens), capped."""
    return rows.agg(F.exp(F.least(F.sum("nll") / F.sum("tokens"), F.lit(cap))).alias("perplexity"))


def f1(rows: DataFrame, classes: int, average: str = "macro") -> DataFrame:
    pred, label = F.col("pred"), F.col("label")
    if average == "micro":
        return rows.agg(F.coalesce(F.avg((pred == label).cast("int")), F.lit(0.0)).alias("f1"))
    scores = []
    for c in range(classes):
        tp, fp, fn = F.count_if((pred == c) & (label == c)), F.count_if((pred == c) & (label != c)), F.count_if((pred != c) & (label == c))
        scores.append(F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0))
    return rows.agg((sum(scores[1:], scores[0]) / classes).alias("f1"))


def tokens(c):
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))


def bleu(rows: DataFrame, max_n: int = 4, smooth: bool = True) -> DataFrame:
    """Corpus BLEU of rows(id, prediction, reference): clipped n-gram counts meet by id and n-gram."""
    t = rows.select("id", tokens(F.col("prediction")).alias("p"), tokens(F.col("reference")).alias("r"))
    sizes = t.agg(F.sum(F.size("p")).alias("np"), F.sum(F.size("r")).alias("nr"), *[F.sum(F.greatest(F.size("p") - (n - 1), F.lit(0))).alias(f"t{n}") for n in range(1, max_n + 1)])

    def grams(side: str, name: str) -> DataFrame:
        def of(n: int):
            gram = lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(side, i, n), " ").alias("g"))
            return F.when(F.size(side) >= n, F.transform(F.sequence(F.lit(1), F.size(side) - (n - 1)), gram)).otherwise(F.array().cast("array<struct<n:int,g:string>>"))

        each = F.flatten(F.array(*[of(n) for n in range(1, max_n + 1)]))
        return t.select("id", F.explode(each).alias("x")).groupBy("id", F.col("x.n").alias("n"), F.col("x.g").alias("g")).agg(F.count("*").alias(name))

    clipped = grams("p", "cp").join(grams("r", "cr"), ["id", "n", "g"]).agg(*[F.coalesce(F.sum(F.when(F.col("n") == n, F.least("cp", "cr"))), F.lit(0)).alias(f"c{n}") for n in range(1, max_n + 1)])
    one = sizes.crossJoin(F.broadcast(clipped))  # one row each
    p = [F.when(F.col(f"t{n}") == 0, 0.0).when((F.col(f"c{n}") == 0) & F.lit(smooth), 1 / (F.col(f"t{n}") + 1)).otherwise(F.col(f"c{n}") / F.when(F.col(f"t{n}") > 0, F.col(f"t{n}"))) for n in range(1, max_n + 1)]
    logs = sum([F.when(x > 0, F.log(x)).otherwise(0.0) for x in p[1:]], F.when(p[0] > 0, F.log(p[0])).otherwise(0.0)) / max_n
    brevity = F.when(F.col("np") >= F.col("nr"), 1.0).otherwise(F.exp(1 - F.col("nr") / F.when(F.col("np") > 0, F.col("np"))))
    nothing = F.greatest(*p) == 0
    return one.select(F.when(nothing, 0.0).otherwise(F.coalesce(brevity, F.lit(0.0)) * F.exp(logs)).alias("bleu"))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of integers."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & places.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def rouge_l(rows: DataFrame) -> DataFrame:
    """id, precision, recall and f1 of rows(id, prediction, reference)."""
    import re

    ship(rows.sparkSession)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, p, r in zip(f["id"], f["prediction"], f["reference"], strict=True):
                a, b = re.findall(r"\w+", (p or "").lower()), re.findall(r"\w+", (r or "").lower())
                n = lcs(a, b) if a and b else 0
                pr, rc = (n / len(a), n / len(b)) if a and b else (0.0, 0.0)
                out.append((i, pr, rc, 2 * pr * rc / (pr + rc) if pr + rc else 0.0))
            yield pd.DataFrame(out, columns=["id", "precision", "recall", "f1"])

    return rows.select("id", "prediction", "reference").mapInPandas(each, "id long, precision double, recall double, f1 double")


def regression_gate(metrics: DataFrame, baseline: DataFrame, most: float = 0.02) -> DataFrame:
    """model, change and passed: the relative growth of perplexity over the baseline's."""
    both = metrics.join(baseline.withColumnRenamed("perplexity", "base"), "model")
    change = (F.col("perplexity") - F.col("base")) / F.greatest("base", F.lit(1e-6))
    return both.select("model", change.alias("change"), (change <= most).alias("passed"))


def r2(rows: DataFrame) -> DataFrame:
    """rows(y, pred)."""
    mean = rows.agg(F.avg("y").alias("m"))
    x = rows.crossJoin(F.broadcast(mean))  # one row
    return x.agg((1 - F.sum(F.pow(F.col("y") - F.col("pred"), 2)) / (F.sum(F.pow(F.col("y") - F.col("m"), 2)) + 1e-10)).alias("r2"))


def keep_checkpoints(rows: DataFrame, last: int, metric: str, lowest: bool = True) -> DataFrame:
    """The last checkpoints of each model and its best one."""
    from pyspark.sql import Window

    newest = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("step")))
    best = F.row_number().over(Window.partitionBy("model").orderBy(F.asc(metric) if lowest else F.desc(metric), "step"))
    return rows.withColumn("__q_n", newest).withColumn("__q_b", best).filter((F.col("__q_n") <= last) | (F.col("__q_b") == 1)).drop("__q_n", "__q_b")


def shaped_reward(base: Column, tokens: Column, least: int, most: int, bonus: float, penalty: float) -> Column:
    """base with the bonus for a number of tokens from least to most (less below, and less the further above), and less a
    penalty for the share of pairs of adjacent tokens that came before."""
    n = F.size(tokens)
    length = F.when(n < least, bonus * n / least - bonus).when(n > most, -bonus * (n - most) / most).otherwise(bonus)
    # Pairs as strings: distinct ones are found by hashing, while structs would be compared each with each. Lengths keep apart
    # what is written alike.
    one = lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    rest = F.greatest(n - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, 1, rest), F.slice(tokens, 2, rest), lambda a, b: F.concat(one(a), one(b)))
    repeats = F.when(n > 2, (n - 1 - F.size(F.array_distinct(pairs))) / (n - 1)).otherwise(0.0)
    return base + length - penalty * repeats
