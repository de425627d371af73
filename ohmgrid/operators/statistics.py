"""Aggregates of aggregates: means of means, medians of medians, robust scales, weighted quantiles, ranks, modes.

Defined results: nulls are left out of values and weights; groups without values give null or no row as named; a spread
of a single value is 0 where a band is asked for; sigmas and correlations leave out rows of a null key; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_of_means(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """(outer, members, mean, low, high): the mean over inner groups' means, and one sample deviation around it."""
    means = df.groupBy(*inner).agg(F.avg(value).alias("_m")).filter("_m IS NOT NULL")
    spread = F.coalesce(F.stddev_samp("_m"), F.lit(0.0))
    return means.groupBy(*outer).agg(F.count("*").alias("members"), F.avg("_m").alias("mean"), (F.avg("_m") - spread).alias("low"), (F.avg("_m") + spread).alias("high"))


def median_of_medians(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """(outer, members, median): the median over inner groups' medians."""
    m = df.groupBy(*inner).agg(F.percentile(value, F.lit(0.5)).alias("_m")).filter("_m IS NOT NULL")
    return m.groupBy(*outer).agg(F.count("*").alias("members"), F.percentile("_m", F.lit(0.5)).alias("median"))


def robust_scale(df: DataFrame, key: list[str], value: str, least: float = 1e-6) -> DataFrame:
    """(key, scale): IQR / 1.349, else the sample deviation, else 1, and at least least."""
    iqr = (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))) / 1.349
    return df.groupBy(*key).agg(F.greatest(F.coalesce(F.nullif(iqr, F.lit(0.0)), F.nullif(F.stddev_samp(value), F.lit(0.0)), F.lit(1.0)), F.lit(least)).alias("scale"))


def robust_sigma(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, n, sigma): 1.4826 MAD of five or more values (0 for fewer), the population deviation where the MAD is 0."""
    own = df.filter(F.col(value).isNotNull()).select(*key, value)
    med = own.groupBy(*key).agg(F.percentile(value, F.lit(0.5)).alias("_med"))
    d = own.join(med, key).withColumn("_d", F.abs(F.col(value) - F.col("_med")))
    mad = 1.4826 * F.percentile("_d", F.lit(0.5))
    return d.groupBy(*key).agg(F.count("*").alias("n"), F.when(F.count("*") < 5, 0.0).when(mad > 0, mad).otherwise(F.stddev_pop(value)).alias("sigma"))


def weighted_quantile(df: DataFrame, key: list[str], value: str, weight: str, q: list[float]) -> DataFrame:
    """(key, q, value): the lowest value at which the running weight reaches q of the whole."""
    w = Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    d = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*key, value).agg(F.sum(weight).alias("_w"))  # one row a distinct value
    run = d.withColumn("_r", F.sum("_w").over(w)).withColumn("_t", F.sum("_w").over(Window.partitionBy(*key))).withColumn("q", F.explode(F.array(*map(F.lit, q))))
    return run.filter(F.col("_r") >= F.col("q") * F.col("_t")).groupBy(*key, "q").agg(F.min(value).alias(value))


def mode(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value, n): the most frequent value, the first by name of equals."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy(F.desc("n"), value)
    return n.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def correlations(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """(key, n, pearson, spearman); ranks of ties are averaged."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())

    def rank(c: str, name: str) -> DataFrame:
        """Average rank of each distinct value."""
        n = d.groupBy(*key, c).agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*key).orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        return n.select(*key, c, (upto - (F.col("_c") - 1) / 2).alias(name))

    r = d.join(rank(x, "_x"), [*key, x]).join(rank(y, "_y"), [*key, y])
    return r.groupBy(*key).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_x", "_y").alias("spearman"))


def fingerprint(df: DataFrame, bucket: list[str], columns: list[str]) -> DataFrame:
    """(bucket, n, digest): counts of a bucket and a sum of its rows' hashes, whatever their order; no row list is kept."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    part = F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*bucket).agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("digest"))


def snapshot_diff(old: DataFrame, new: DataFrame, bucket: list[str]) -> DataFrame:
    """(bucket, change): buckets of two fingerprints that were added, removed or changed."""
    o = old.select(*bucket, F.col("n").alias("n_old"), F.col("digest").alias("d_old"))
    j = new.select(*bucket, F.col("n").alias("n_new"), F.col("digest").alias("d_new")).join(o, bucket, "full")
    change = F.when(F.col("d_old").isNull(), "added").when(F.col("d_new").isNull(), "removed").when(F.col("d_old") != F.col("d_new"), "changed")
    return j.withColumn("change", change).filter("change IS NOT NULL").select(*bucket, "n_old", "n_new", "change")
