"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's mean repetition rate is its target share of the corpus over its own share, by characters. A document's number
of copies is the Poisson distribution with that mean, inverted at a uniform number hashed from a seed, its id and its text;
rates above ``STEP`` are sums of independent draws. Copies are then dealt over all partitions by a hash and sorted by it.

Default targets are each source's share to the power ``alpha``, made to sum to 1. The rates are one row a source: they
are broadcast only if they take at most ``MAX_BROADCAST`` bytes, and joined by a salted shuffle otherwise, in which a source
of many documents stands in many tasks.

Defined cases: a null source is a source of its own; sources without characters have rate 1; sources that explicit targets
leave out have rate 0; null ids are an id like others, and only rows of equal id and text draw alike; an empty table gives
an empty result; columns of the input are kept, whatever their names, and a column that has the name of the copies' number
makes that one end with underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import salted_join
from quern.plans.lineage import cut

ALPHA, SEED = 0.5, 17
MAX_BROADCAST = 16 << 20
#: Mean of one draw at most, and the number of values that its distribution is kept for; what lies beyond is below 1e-30.
STEP, VALUES = 16.0, 100


def rates(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """source, size and rate of each source of docs(source, text)."""
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double").alias("size"))
    if targets is None:
        wanted = sizes.withColumn("weight", F.pow("size", F.lit(alpha)))
    else:
        given = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair]) if targets else F.create_map().cast("map<string,double>")
        wanted = sizes.withColumn("weight", F.coalesce(given[F.col("source")].cast("double"), F.lit(0.0)))
    totals = wanted.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    share = F.col("weight") / F.col("all_weight")
    rate = F.when((F.col("size") > 0) & (F.col("all_weight") > 0), share * F.col("all_size") / F.col("size")).otherwise(1.0)
    return wanted.crossJoin(F.broadcast(totals)).select("source", "size", rate.alias("rate"))  # totals: one row


def distribution(mean: Column) -> Column:
    """P(X <= k) of a Poisson variable with this mean for k from 0, as an array."""
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * mean / k
        return F.struct(term.alias("term"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + term)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(VALUES)), start, step)["sums"]


def uniform(row: Column, draw: Column, seed: int) -> Column:
    """52 bits of a hash of a row's name, as a number of [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), row, draw.cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = ALPHA, seed: int = SEED, copy_column: str | None = "copy") -> DataFrame:
    """The columns of docs, once for each copy, in a global random order; copy_column numbers the copies from 1."""
    name = F.concat(F.lit("s"), F.col("source").cast("string"))
    key = F.coalesce(name, F.lit("null"))
    draws = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    table = cut(rates(docs.select("source", "text"), targets, alpha))
    size = table.agg(F.sum(F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + 8 * VALUES + 100)).first()[0] or 0
    table = table.select(key.alias("__q_source"), draws.alias("__q_draws"), distribution(F.col("rate") / draws).alias("__q_sums"))
    # A row's name: its id and a hash of its text, so that unlike rows that share an id, or have none, draw on their own.
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.md5("text"), F.lit("null")))
    keyed = docs.withColumn("__q_source", key).withColumn("__q_row", row)
    joined = keyed.join(F.broadcast(table), "__q_source") if size <= MAX_BROADCAST else salted_join(keyed, table, "__q_source", by=["doc_id", "text"], salts=64)

    def drawn(total: Column, j: Column) -> Column:
        u = uniform(F.col("__q_row"), j, seed)
        return total + F.size(F.filter("__q_sums", lambda p: p <= u))

    n = F.aggregate(F.sequence(F.lit(1), F.col("__q_draws")), F.lit(0), drawn)
    counted = joined.withColumn("__q_n", n).filter(F.col("__q_n") > 0)
    copies = counted.withColumn("__q_copy", F.explode(F.sequence(F.lit(1), F.col("__q_n"))))
    dealt = copies.withColumn("__q_key", F.xxhash64(F.lit(seed), F.col("__q_row"), F.col("__q_copy")))
    out = dealt.repartition(F.col("__q_key")).sortWithinPartitions("__q_key")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    while copy_column and copy_column.lower() in [c.lower() for c in docs.columns]:
        copy_column += "_"
    return out.select(*kept, *([F.col("__q_copy").alias(copy_column)] if copy_column else []))


SQL = f"""
WITH sizes AS (SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS size FROM documents GROUP BY source),
totals AS (SELECT sum(size) AS all_size, sum(pow(size, {ALPHA})) AS all_weight FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 THEN pow(size, {ALPHA}) / all_weight * all_size / size ELSE 1.0 END AS rate FROM sizes, totals),
draws AS (SELECT source, greatest(ceil(rate / {STEP}), 1)::INT AS m, rate / greatest(ceil(rate / {STEP}), 1) AS l FROM rates),
sums AS (SELECT source, m, list_transform(range({VALUES} + 1), lambda k: list_sum(list_transform(range(k + 1), lambda i: exp(i * ln(l) - l - lgamma(i + 1))))) AS p FROM draws),
counted AS (SELECT d.*, list_sum(list_transform(range(1, m + 1), lambda j: len(list_filter(p, lambda x:
  x <= ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || coalesce(md5(d.text), 'null') || ':' || j), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE))))::INT AS n
  FROM documents d JOIN sums ON d.source IS NOT DISTINCT FROM sums.source)
SELECT * EXCLUDE (n, copies), copies::INT AS copy FROM (SELECT *, unnest(range(1, n + 1)) AS copies FROM counted)
"""
