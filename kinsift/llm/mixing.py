"""Mixing sources to target weights by Poisson replication.

A document is repeated k times, where k is the value of a Poisson distribution with the mean
that its source's target share asks for, inverted at a number that a hash of the id and a seed
gives. The same seed gives the same mix on any cluster. Copies are then dealt out by another hash
and sorted by it within partitions: a global shuffle that needs no sampling pass.

A null source is a source of its own; a null id is hashed as an empty one, so that its rows
share their number of copies; repeated rows are repeated likewise. Sources without a
weight get none. An empty table gives an empty mix. Other columns stay as they are; if docs has a column of the
name that one of the three new ones would get, the new one gets underscores behind its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.plans import scratch

#: What is broadcast: so many thresholds of sources (of 8 bytes each) at most.
MOST_THRESHOLDS = 1 << 20


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def thresholds(rate: Column) -> Column:
    """P(K <= 0), P(K <= 1), ... of the Poisson distribution, until the rest is below 2**-52.

    A rate over 500 is a sum of equal parts below; see copies()."""
    most = (F.ceil(rate + 12 * F.sqrt(rate)) + 30).cast("int")
    term = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))
    step = lambda s, j: F.struct((s["p"] * rate / j).alias("p"), (s["c"] + s["p"] * rate / j).alias("c"), F.array_append(s["all"], s["c"] + s["p"] * rate / j).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), most), term, step, lambda s: s["all"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source", temperature: float = 0.5, size: float | None = None) -> DataFrame:
    """Sources with their number of rows, target share, and mean number of copies.

    weights: the target share of each source (any scale); without it a source's share is its
    number of rows to the power `temperature`. size: expected rows of the mix (as many as
    there are without it)."""
    counts = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("n_source"))
    if weights is None:
        share = F.pow(F.col("n_source").cast("double"), F.lit(temperature))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    counts = counts.withColumn("_w", share)
    total = counts.agg(F.sum("_w").alias("_tw"), F.sum("n_source").alias("_tn"))  # one row
    counted = counts.join(F.broadcast(total))
    rate = F.coalesce(F.try_divide(F.col("_w") * F.lit(float(size)) if size else F.col("_w") * F.col("_tn"), F.col("_tw") * F.col("n_source")), F.lit(0.0))
    return counted.select("_source", "n_source", F.coalesce(F.try_divide(F.col("_w"), F.col("_tw")), F.lit(0.0)).alias("share"), rate.alias("rate"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", temperature: float = 0.5, size: float | None = None, partitions: int | None = None) -> DataFrame:
    """docs, each row as often as drawn, with copy_no (from 0), n_copies and shuffle_key, dealt
    out and sorted by shuffle_key within partitions."""
    copy_no, n_copies, shuffle_key = (scratch.unused(docs, c) for c in ("copy_no", "n_copies", "shuffle_key"))
    # a mean too large for exp() is drawn as a sum of equal parts
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / 500)).cast("int")
    table = rates(docs, weights, source_col, temperature, size).withColumn("parts", parts)
    table = table.select(F.struct("_source", "parts", thresholds(F.col("rate") / F.col("parts")).alias("cdf")).alias("of"))
    held = table.limit(MOST_THRESHOLDS + 1).agg(F.coalesce(F.sum(F.size("of.cdf")), F.lit(0)).alias("n")).first()["n"]
    side = F.broadcast(table) if held <= MOST_THRESHOLDS else table  # else a join that splits a hot source
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    drawn = rows.join(side, F.col(f"row.`{source_col}`").eqNullSafe(F.col("of._source")))
    key = F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit(""))
    one = lambda part: F.size(F.filter("of.cdf", lambda c: c < uniform(F.lit(str(seed)), part, key)))
    n = F.col("of.parts")
    count = F.when(n == 1, one(F.lit("0"))).otherwise(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda k: one(k.cast("string"))), F.lit(0), lambda a, b: a + b))
    drawn = drawn.select("row", count.alias("n"), key.alias("key")).where("n > 0")
    copies = drawn.select("row", "n", "key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    dealt = copies.withColumn("at", F.xxhash64(F.lit(seed), "key", "k"))
    to = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = dealt.repartition(to, "at").sortWithinPartitions("at")
    return out.select("row.*", F.col("k").alias(copy_no), F.col("n").alias(n_copies), F.col("at").alias(shuffle_key))


def poisson(u: float, rate: float) -> int:
    """The inverse that `mixed` draws by, for one number (rates up to 500)."""
    k, p = 0, math.exp(-rate)
    c = p
    while c < u:
        k += 1
        p *= rate / k
        c += p
    return k
