"""Quality of pairs, bootstrap samples, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsift.operators.vocabulary import dense_index
from kinsift.sources.results import METRICS


def true_pairs(products: DataFrame) -> DataFrame:
    """i, j (i < j) of one model."""
    a, b = products.select("model_id", F.col("product_idx").alias("i")), products.select("model_id", F.col("product_idx").alias("j"))
    return a.join(b.hint("merge"), "model_id").where("i < j").select("i", "j")


def in_sample(pairs: DataFrame, sample: DataFrame) -> DataFrame:
    """Pairs both of whose products are in the sample."""
    s = sample.select("product_idx").distinct()
    return pairs.join(s.withColumnRenamed("product_idx", "i"), "i", "left_semi").join(s.withColumnRenamed("product_idx", "j"), "j", "left_semi").select("i", "j")


def found_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.select("i", "j").intersect(truth.select("i", "j"))


def quality(found: Column, comparisons: Column) -> Column:
    """Null without comparisons."""
    return F.try_divide(found.cast("double"), comparisons)


def completeness(found: Column, total: Column) -> Column:
    """Null without true pairs."""
    return F.try_divide(found.cast("double"), total)


def f1(pq: Column, pc: Column) -> Column:
    """0 where both are 0."""
    return F.coalesce(F.try_divide(2 * pq * pc, pq + pc), F.lit(0.0))


def fraction_of_comparisons(comparisons: Column, n: Column) -> Column:
    return F.try_divide(comparisons.cast("double"), n * (n - 1) / 2)


def pair_metrics(pairs: DataFrame, truth: DataFrame, products: DataFrame) -> DataFrame:
    """One row: comparisons, found, total, n, and pq, pc, f1, foc."""
    return counted_metrics(pairs.agg(F.count("*").alias("comparisons")), found_pairs(pairs, truth), truth, products)


def counted_metrics(comparisons: DataFrame, found: DataFrame, truth: DataFrame, products: DataFrame) -> DataFrame:
    """The same of a count of comparisons (one row) and the true pairs among them."""
    return _metrics([comparisons, found.agg(F.count("*").alias("found")), truth.agg(F.count("*").alias("total")), products.agg(F.count_distinct("product_idx").alias("n"))])


def _metrics(counts: list[DataFrame]) -> DataFrame:
    one = counts[0]
    for c in counts[1:]:
        one = one.join(F.broadcast(c))  # of one row each
    one = one.withColumn("pq", quality(F.col("found"), F.col("comparisons"))).withColumn("pc", completeness(F.col("found"), F.col("total")))
    return one.withColumn("f1", f1(F.col("pq"), F.col("pc"))).withColumn("foc", fraction_of_comparisons(F.col("comparisons"), F.col("n")))


def cluster_metrics(pairs: DataFrame, candidates: DataFrame, truth: DataFrame, products: DataFrame) -> DataFrame:
    """pair_metrics of clustered pairs; comparisons are all candidates, before pruning."""
    counts = [candidates.agg(F.count("*").alias("comparisons")), found_pairs(pairs, truth).agg(F.count("*").alias("found")), truth.agg(F.count("*").alias("total")), products.agg(F.count_distinct("product_idx").alias("n"))]
    return _metrics(counts)


def bootstrap_samples(products: DataFrame, n_bootstraps: int = 5, seed: int = 559692) -> DataFrame:
    """bootstrap, split, local_pos, product_idx: as many draws with replacement as there are
    products ('train'), and the products that were not drawn ('test').

    A draw is a hash of seed, bootstrap and position, so that draws are made where their rows are
    and are the same on any cluster."""
    ranked = dense_index(products.select("product_idx"), "product_idx", F.floor(F.col("product_idx") / 4096), "ordinal")
    n = products.agg(F.count("*").alias("n"))
    spots = ranked.join(F.broadcast(n)).select("n", F.col("ordinal").alias("local_pos"), F.explode(F.sequence(F.lit(0), F.lit(n_bootstraps - 1))).alias("bootstrap"))
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("bootstrap").cast("string"), F.col("local_pos").cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
    drawn = spots.select("bootstrap", "local_pos", (digits % F.col("n")).alias("ordinal")).join(ranked, "ordinal").select("bootstrap", "local_pos", "product_idx")
    every = ranked.select("product_idx", F.explode(F.sequence(F.lit(0), F.lit(n_bootstraps - 1))).alias("bootstrap"))
    left = every.join(drawn.select("bootstrap", "product_idx").distinct(), ["bootstrap", "product_idx"], "left_anti")
    left = dense_index(left, "product_idx", F.floor(F.col("product_idx") / 4096), "local_pos", by=("bootstrap",))
    return drawn.select("bootstrap", F.lit("train").alias("split"), "local_pos", "product_idx").unionByName(left.select("bootstrap", F.lit("test").alias("split"), "local_pos", "product_idx"))


def summarize(results: DataFrame) -> DataFrame:
    """Means of all metrics by configuration, in order of the fraction of comparisons."""
    return results.groupBy("r", "b", "t").agg(*(F.avg(m).alias(m) for m in METRICS)).orderBy("foc_lsh", "r")


def curves(summary: DataFrame) -> DataFrame:
    """foc to pc, pq, f1_star and f1; all over foc_lsh."""
    return summary.select("r", "foc_lsh", "pc_lsh", "pq_lsh", "f1_star", "f1")


def fair_auc(first: DataFrame, second: DataFrame, x: str = "foc_lsh", y: str = "pc_lsh") -> DataFrame:
    """One row: the areas under both curves up to the lesser of their largest x."""
    both = first.select(F.lit("first").alias("c"), F.col(x).alias("x"), F.col(y).alias("y"), "r").unionByName(second.select(F.lit("second").alias("c"), F.col(x).alias("x"), F.col(y).alias("y"), "r"))
    both = both.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    end = both.groupBy("c").agg(F.max("x").alias("m")).agg(F.min("m").alias("end"))
    w = Window.partitionBy("c").orderBy("x", "r")
    steps = both.join(F.broadcast(end)).where("x <= end").select("c", "x", "y", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"))
    area = lambda name: F.coalesce(F.sum(F.when(F.col("c") == name, (F.col("x") - F.col("px")) * (F.col("y") + F.col("py")) / 2)), F.lit(0.0))
    return steps.agg(area("first").alias("auc_first"), area("second").alias("auc_second"))
