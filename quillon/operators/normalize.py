"""Normalization of counts by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import ratio


def median_log1p(assay: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """log1p(median total * x / total). Empty cells of ``cells`` count as total 1 in the median."""
    total = assay.groupBy("cell_id").agg(F.sum("value").alias("t"))
    every = total if cells is None else cells.select("cell_id").join(total, "cell_id", "left")
    size = every.select("cell_id", F.when(F.coalesce("t", F.lit(0.0)) == 0, 1.0).otherwise(F.col("t")).alias("t"))
    mid = size.agg(F.median("t").alias("m"))  # one row
    return assay.join(size, "cell_id").crossJoin(F.broadcast(mid)).select("feature_id", "cell_id", F.log1p(F.col("m") * F.col("value") / F.col("t")).alias("value"))


def log_cpm(assay: DataFrame) -> DataFrame:
    """log2(1 + counts per million)."""
    total = F.sum("value").over(Window.partitionBy("cell_id"))
    return assay.withColumn("value", F.log2(ratio(1e6 * F.col("value"), total) + 1))


def _scaled(assay: DataFrame, factors: DataFrame) -> DataFrame:
    return assay.join(factors, "cell_id").withColumn("value", F.log2(ratio(F.col("value"), F.col("factor")) + 1)).drop("factor")


def median_ratio_factors(assay: DataFrame, n_cells: int) -> DataFrame:
    """(cell_id, factor): the median ratio to the geometric mean of features that every cell has."""
    shared = assay.where("value > 0").groupBy("feature_id").agg(F.count("*").alias("n"), F.avg(F.ln("value")).alias("g")).where(F.col("n") == n_cells)
    return assay.join(shared, "feature_id").groupBy("cell_id").agg(F.exp(F.median(F.ln("value") - F.col("g"))).alias("factor"))


def median_ratio(assay: DataFrame, n_cells: int) -> DataFrame:
    """log2(1 + x / factor) with factors centred at mean 1."""
    f = median_ratio_factors(assay, n_cells)
    mean = f.agg(F.avg("factor").alias("m"))
    return _scaled(assay, f.crossJoin(F.broadcast(mean)).select("cell_id", (F.col("factor") / F.col("m")).alias("factor")))


def trimmed_mean_factors(assay: DataFrame, log_ratio_trim: float = 0.3, sum_trim: float = 0.05) -> DataFrame:
    """(cell_id, factor): trimmed mean of M values against a reference cell, the one whose upper quartile
    is nearest the mean upper quartile, by the published formula; factors multiply to 1."""
    size = assay.groupBy("cell_id").agg(F.sum("value").alias("lib"))
    a = assay.where("value > 0").join(size, "cell_id")
    q = a.groupBy("cell_id").agg(F.percentile("value", F.lit(0.75)).alias("q"), F.first("lib").alias("lib")).withColumn("q", F.col("q") / F.col("lib"))
    mean = q.agg(F.avg("q").alias("mq"))
    ref = q.crossJoin(F.broadcast(mean)).orderBy(F.abs(F.col("q") - F.col("mq")), "cell_id").limit(1).select("cell_id")
    r = a.join(F.broadcast(ref), "cell_id", "left_semi").select("feature_id", F.col("value").alias("rv"), F.col("lib").alias("rl"))
    b = a.join(r, "feature_id")
    x, y = F.col("value") / F.col("lib"), F.col("rv") / F.col("rl")
    b = b.withColumn("m", F.log2(x / y)).withColumn("a", F.log2(x * y) / 2)
    var = (F.col("lib") - F.col("value")) / F.col("lib") / F.col("value") + (F.col("rl") - F.col("rv")) / F.col("rl") / F.col("rv")
    w = Window.partitionBy("cell_id")
    b = b.withColumn("v", var).withColumn("n", F.count("*").over(w))
    b = b.withColumn("rm", F.rank().over(w.orderBy("m"))).withColumn("ra", F.rank().over(w.orderBy("a")))
    low_m, low_a = F.floor(F.col("n") * log_ratio_trim) + 1, F.floor(F.col("n") * sum_trim) + 1
    kept = b.where((F.col("rm") >= low_m) & (F.col("rm") <= F.col("n") + 1 - low_m) & (F.col("ra") >= low_a) & (F.col("ra") <= F.col("n") + 1 - low_a))
    f = kept.where("v > 0").groupBy("cell_id").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("l"))
    f = size.select("cell_id").join(f, "cell_id", "left").withColumn("l", F.coalesce("l", F.lit(0.0)))
    mid = f.agg(F.avg("l").alias("ml"))
    return f.crossJoin(F.broadcast(mid)).select("cell_id", F.pow(F.lit(2.0), F.col("l") - F.col("ml")).alias("factor"))


def trimmed_mean(assay: DataFrame) -> DataFrame:
    """log2(1 + x / (factor * total / mean total))."""
    size = assay.groupBy("cell_id").agg(F.sum("value").alias("lib"))
    mean = size.agg(F.avg("lib").alias("ml"))
    f = size.join(trimmed_mean_factors(assay), "cell_id").crossJoin(F.broadcast(mean))
    return _scaled(assay, f.select("cell_id", (F.col("factor") * F.col("lib") / F.col("ml")).alias("factor")))


def cluster_factors(assay: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """log2(1 + x / factor), factor the total over the mean total of the cell's cluster (or of all): the
    documented substitute for pooled size factors."""
    size = assay.groupBy("cell_id").agg(F.sum("value").alias("lib"))
    w = Window.partitionBy("label") if clusters is not None else Window.partitionBy(F.lit(0))
    if clusters is None:
        mean = size.agg(F.avg("lib").alias("ml"))
        placed = size.crossJoin(F.broadcast(mean))
    else:
        placed = size.join(clusters.select("cell_id", "label"), "cell_id").withColumn("ml", F.avg("lib").over(w))
    return _scaled(assay, placed.select("cell_id", (F.col("lib") / F.col("ml")).alias("factor")))


def normalize(assay: DataFrame, method: str = "default", n_cells: int | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """By name: default, logCPM, DESeq2, TMM, scran. Methods of outside packages raise."""
    if method == "default":
        return median_log1p(assay)
    if method == "logCPM":
        return log_cpm(assay)
    if method == "TMM":
        return trimmed_mean(assay)
    if method == "DESeq2":
        return median_ratio(assay, n_cells if n_cells is not None else assay.select("cell_id").distinct().count())
    if method == "scran":
        return cluster_factors(assay, clusters)
    raise ValueError(f"normalization {method!r} needs an outside package and is not supported")
