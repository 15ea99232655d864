"""Annotation of clusters, states and cells that combines the other operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import hypergeometric_tail, ratio
from quillon.operators import filters, graph, labels, linalg, specificity


def set_overlap(features: DataFrame, sets: DataFrame, n_features: int, top: int | None = 10, longest: int = 50) -> DataFrame:
    """(set_name, n, value): sets with a name of at most ``longest`` letters that hold more of ``features``
    than expected, by the hypergeometric bound as -log10, the ``top`` highest (all, if None). An offline
    stand-in for a remote enrichment service."""
    f = features.select("feature_id").distinct()
    size = sets.distinct().groupBy("set_name").agg(F.count("*").alias("size"))
    hits = sets.distinct().join(F.broadcast(f), "feature_id", "left_semi").groupBy("set_name").agg(F.count("*").alias("n"))
    one = f.agg(F.count("*").alias("asked"))
    both = size.join(hits, "set_name").crossJoin(F.broadcast(one)).where(F.length("set_name") <= longest)
    scored = both.select("set_name", "n", (hypergeometric_tail(F.lit(n_features), "size", "asked", "n") / math.log(10)).alias("value"))
    return scored if top is None else scored.orderBy(F.desc(F.round("value", 9)), "set_name").limit(top)


def combined_activities(scores: DataFrame, libraries: dict[str, DataFrame], n_rows: int) -> DataFrame:
    """(group, set_name, value): enrichment of every library's sets, combined over the libraries that have a
    set by the log of the mean of 10^value."""
    every = None
    for name in sorted(libraries):
        e = specificity.chernoff_enrichment(scores, libraries[name], n_rows, False)
        every = e if every is None else every.unionByName(e)
    keyed = every.withColumn("key", F.struct("group", "set_name"))
    return specificity.log_mean_exp(keyed, "key").select("key.group", "key.set_name", "value")


def signature_profile(loadings: DataFrame, cells: DataFrame, c: DataFrame) -> DataFrame:
    """(feature_id, arch, value): loadings times the archetypes' reduced vectors, two small products."""
    dims = linalg.dense(cells, "cell_id", "vec")
    points = linalg.product(dims, c, "cell_id", "dim", "arch")
    return linalg.product(linalg.dense(loadings, "feature_id", "vec"), points, "dim", "feature_id", "arch")


def annotate_clusters(clusters: DataFrame, known: DataFrame) -> DataFrame:
    """(cluster, label, confidence, full_name): each cluster's most over-represented known label."""
    o = labels.overlap(known, clusters).select(F.col("label_b").alias("cluster"), F.col("label_a").alias("label"), "value")
    return labels.best_label(o, "cluster").withColumn("full_name", F.concat(F.lit("Cluster "), F.col("cluster"), F.lit(" ("), F.col("label"), F.lit(")")))


def annotate_archetypes_by_labels(h: DataFrame, known: DataFrame) -> DataFrame:
    """(arch, label, confidence): the known label in whose cells an archetype is highest, by Welch's t.
    ``h`` is dense."""
    t = specificity.welch_t(h.select("cell_id", F.col("arch").alias("dim"), "value"), known)
    return labels.best_label(t.select(F.col("dim").alias("arch"), "label", F.col("t").alias("value")), "arch")


def annotate_cells_by_archetypes(assignments: DataFrame, archetype_labels: DataFrame, least: float = 3.0) -> DataFrame:
    """(cell_id, label, confidence): the label of each cell's archetype, ? below ``least``."""
    named = archetype_labels.select(F.col("group").alias("state"), F.when(F.col("confidence") >= least, F.col("label")).otherwise("?").alias("label"), "confidence")
    return assignments.select("cell_id", "state").join(F.broadcast(named), "state", "left").select("cell_id", "label", "confidence")


def prioritize_celltypes(scores: DataFrame, markers: DataFrame, n_rows: int) -> DataFrame:
    """(group, label, confidence, kept): each state's best cell type; types are kept up to the effective
    number (participation ratio) of the confidences."""
    best = labels.annotate_by_markers(scores, markers, n_rows)
    q = F.greatest("confidence", F.lit(0.0)) * F.greatest("confidence", F.lit(0.0))
    n = best.agg(F.round(ratio(F.pow(F.sum(q), F.lit(2.0)), F.sum(q * q))).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("confidence", 9)), "group"))  # a row for each state
    return best.withColumn("r", rank).crossJoin(F.broadcast(n)).select("group", "label", "confidence", (F.col("r") <= F.col("n")).alias("kept"))


def suggest_markers(scores: DataFrame, sets: DataFrame, n_rows: int, least: float = 2.0) -> DataFrame:
    """(src, dst, weight): states matched with marker sets of enrichment ``least`` or more, at the largest
    total."""
    e = specificity.chernoff_enrichment(scores, sets, n_rows).where(F.col("value") >= least)
    return graph.max_weight_matching(e.select(F.col("group").alias("src"), F.col("set_name").alias("dst"), F.col("value").alias("weight")))


def classify_archetypes(backbone: DataFrame, least_z: float = -1.0) -> DataFrame:
    """(arch, clustered): whether an archetype's own Moran value (the diagonal of ``backbone(a, b, value)``),
    standardized, is at least ``least_z``."""
    d = backbone.where("a = b").select(F.col("a").alias("arch"), "value")
    s = d.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return d.crossJoin(F.broadcast(s)).select("arch", (ratio(F.col("value") - F.col("m"), F.col("s")) >= least_z).alias("clustered"))


def _student_tail(t: float, df: float) -> float:
    """P(T > t) of Student's distribution, by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t) or df <= 0:
        return 1.0 if not t > 0 else 0.0
    x = df / (df + t * t)
    a, b = df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + num / (c if abs(c) > 1e-300 else 1e-300)
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        both = 1.0
    elif x < (a + 1) / (a + b + 2):
        both = front * fraction(a, b, x) / a
    else:
        both = 1 - front * fraction(b, a, 1 - x) / b
    return both / 2 if t > 0 else 1 - both / 2


def phenotype_features(assay: DataFrame, cells: DataFrame, direction: str = "up") -> DataFrame:
    """(cluster, feature_id, log_fc, t, p, fdr): Welch's test of cases against controls within each cluster,
    for ``cells(cell_id, cluster, case)``; zeros count. FDR is within the cluster."""
    size = cells.groupBy("cluster").agg(F.count_if("case").alias("n1"), F.count_if(~F.col("case")).alias("n0"))
    x, q = F.col("value"), F.col("value") * F.col("value")
    case = F.col("case")
    s = assay.join(cells, "cell_id").groupBy("cluster", "feature_id").agg(
        F.sum(F.when(case, x).otherwise(0.0)).alias("s1"), F.sum(F.when(case, q).otherwise(0.0)).alias("q1"), F.sum(F.when(~case, x).otherwise(0.0)).alias("s0"), F.sum(F.when(~case, q).otherwise(0.0)).alias("q0")
    )
    c = F.col
    s = s.join(F.broadcast(size), "cluster").where("n1 > 1 and n0 > 1")
    s = s.withColumn("v1", F.greatest(F.lit(0.0), (c("q1") - c("s1") * c("s1") / c("n1")) / (c("n1") - 1)) / c("n1")).withColumn("v0", F.greatest(F.lit(0.0), (c("q0") - c("s0") * c("s0") / c("n0")) / (c("n0") - 1)) / c("n0"))
    gap = c("s1") / c("n1") - c("s0") / c("n0")
    s = s.withColumn("log_fc", gap).withColumn("t", ratio(gap, F.sqrt(c("v1") + c("v0"))))
    s = s.withColumn("df", ratio((c("v1") + c("v0")) * (c("v1") + c("v0")), c("v1") * c("v1") / (c("n1") - 1) + c("v0") * c("v0") / (c("n0") - 1)))
    sign = 1.0 if direction == "up" else -1.0
    kinds = dict(s.dtypes)

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["p"] = [_student_tail(sign * t, df) for t, df in zip(b["t"], b["df"], strict=True)]
            yield b[["cluster", "feature_id", "log_fc", "t", "p"]]

    tested = s.select("cluster", "feature_id", "log_fc", "t", "df").mapInPandas(tails, f"cluster {kinds['cluster']}, feature_id {kinds['feature_id']}, log_fc double, t double, p double")
    return specificity.benjamini_hochberg(tested, "p", "cluster")


def phenotype_features_by_individual(assay: DataFrame, cells: DataFrame, least_cells: int = 10, direction: str = "up") -> DataFrame:
    """(cluster, feature_id, log_fc, sd, p, fdr): every case individual against every control individual of a
    cluster with more than ``least_cells`` cells each, for ``cells(cell_id, cluster, case, individual)``: the
    sum and deviation of differences and the harmonic mean of p-values."""
    n = cells.groupBy("cluster", "case", "individual").agg(F.count("*").alias("n")).where(F.col("n") > least_cells)
    a = n.where("case").select("cluster", F.col("individual").alias("x"))
    b = n.where("not case").select("cluster", F.col("individual").alias("y"))
    pairs = a.join(b, "cluster").withColumn("pair", F.concat_ws("|", F.col("cluster").cast("string"), F.col("x").cast("string"), F.col("y").cast("string")))
    placed = cells.join(F.broadcast(pairs), "cluster").where("(case and individual = x) or (not case and individual = y)")
    each = phenotype_features(assay, placed.select("cell_id", F.col("pair").alias("cluster"), "case"), direction)
    each = each.withColumnRenamed("cluster", "pair").join(F.broadcast(pairs.select("pair", "cluster")), "pair")
    total = each.groupBy("cluster", "feature_id").agg(
        F.sum("log_fc").alias("log_fc"), F.coalesce(F.stddev_samp("log_fc"), F.lit(0.0)).alias("sd"), (F.count("*") / F.sum(1.0 / F.greatest("p", F.lit(1e-300)))).alias("p")
    )
    return specificity.benjamini_hochberg(total, "p", "cluster")


def selected_means(assay: DataFrame, known: DataFrame, features: DataFrame) -> DataFrame:
    """(feature_id, label, value): means of some features by label, zeros included, for a heat map."""
    size = known.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    s = assay.join(F.broadcast(features.select("feature_id").distinct()), "feature_id", "left_semi").join(known, "cell_id").groupBy("feature_id", "label").agg(F.sum("value").alias("s"))
    return s.join(F.broadcast(size), "label").select("feature_id", "label", (F.col("s") / F.col("n")).alias("value"))


def allowed_features(scores: DataFrame, subset: DataFrame | None = None, pattern: str | None = None) -> DataFrame:
    """Scores of features in ``subset`` whose names do not match the blacklist ``pattern``."""
    out = scores if subset is None else scores.join(F.broadcast(subset.select("feature_id").distinct()), "feature_id", "left_semi")
    return out if pattern is None else filters.drop_blacklisted(out, "feature_id", pattern)
