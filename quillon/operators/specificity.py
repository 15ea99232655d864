"""Feature specificity and set enrichment by the Chernoff bound.

Expected sums are products of marginals (rank one), so each operator is a few hash aggregates, one
equi-join for what was observed, and a product of two marginal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import LN10, chernoff, ratio


def _group_weights(groups: DataFrame, beta: DataFrame) -> DataFrame:
    """(group, s1, s2, a): sums, sums of squares and maximum of weight * beta."""
    g = groups.join(beta, "cell_id").withColumn("g", F.col("weight") * F.col("beta"))
    return g.groupBy("group").agg(F.sum("g").alias("s1"), F.sum(F.col("g") * F.col("g")).alias("s2"), F.max("g").alias("a"))


def _beta(assay: DataFrame, n_features: int, n_cells: int) -> DataFrame:
    """(cell_id, beta): the share of features a cell has, over the mean share of all cells."""
    pc = assay.groupBy("cell_id").agg((F.count_if(F.col("value") != 0) / F.lit(float(n_features))).alias("pc"))
    rho = pc.agg((F.sum("pc") / F.lit(float(n_cells))).alias("rho"))
    return pc.crossJoin(F.broadcast(rho)).select("cell_id", ratio("pc", "rho").alias("beta"))


def feature_specificity(assay: DataFrame, groups: DataFrame, n_features: int, n_cells: int, baseline: DataFrame | None = None, baseline_cells: int | None = None) -> DataFrame:
    """(feature_id, group, profile, significance, down): how far each feature exceeds, in cells of a
    group, what its mean and the cells' sizes predict.

    ``groups(cell_id, group, weight)``: labels with weight 1, or memberships. With ``baseline`` the
    expected means come from these control cells, and ``down`` bounds the deficit.
    """
    w = _group_weights(groups, _beta(assay, n_features, n_cells))
    base, n_base = (assay, n_cells) if baseline is None else (baseline, baseline_cells)
    pr = base.groupBy("feature_id").agg((F.sum("value") / F.lit(float(n_base))).alias("pr"))
    if baseline is not None:  # features that only cases have are expected to be 0
        pr = assay.select("feature_id").distinct().join(pr, "feature_id", "full").withColumn("pr", F.coalesce("pr", F.lit(0.0)))
    obs = assay.join(groups, "cell_id").groupBy("feature_id", "group").agg(F.sum(F.col("value") * F.col("weight")).alias("o"))
    grid = pr.crossJoin(F.broadcast(w)).join(obs, ["feature_id", "group"], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    exp, nu = F.col("pr") * F.col("s1"), F.col("pr") * F.col("s2")
    gap = F.col("o") - exp
    profile = F.col("o") / F.lit(float(n_cells))
    down = F.when(gap > 0, 0.0).otherwise(ratio(gap * gap, 2.0 * nu) / LN10)
    return grid.select("feature_id", "group", profile.alias("profile"), chernoff(F.col("o"), exp, nu, F.col("a")).alias("significance"), down.alias("down"))


def top_features(scores: DataFrame, k: int = 20, score: str = "significance", digits: int = 9) -> DataFrame:
    """The k features of each group with the highest score; ties by feature."""
    w = Window.partitionBy("group").orderBy(F.desc(F.round(score, digits)), "feature_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def differential_scores(scores: DataFrame, k: int = 20) -> DataFrame:
    """All groups' scores of every feature that is in the top k of any."""
    return scores.join(top_features(scores, k).select("feature_id").distinct(), "feature_id", "left_semi")


def chernoff_enrichment(scores: DataFrame, sets: DataFrame, n_rows: int, row_scaling: bool = True) -> DataFrame:
    """(set_name, group, value): -log10 bounds of the sums of ``scores(feature_id, group, value)`` over
    ``sets(set_name, feature_id)``; with ``row_scaling`` expected sums weigh each feature by the share
    of sets that hold it."""
    sets = sets.distinct()
    size = sets.groupBy("set_name").agg((F.count("*") / F.lit(float(n_rows))).alias("ps"))
    top = scores.groupBy("group").agg(F.greatest(F.max("value"), F.lit(0.0)).alias("top"))
    if row_scaling:
        n_sets = size.count()
        pr = sets.groupBy("feature_id").agg((F.count("*") / F.lit(float(n_sets))).alias("pr"))
        rho = pr.agg((F.sum("pr") / F.lit(float(n_rows))).alias("rho"))
        m = scores.join(pr, "feature_id").groupBy("group").agg(F.sum(F.col("pr") * F.col("value")).alias("e"), F.sum(F.col("pr") * F.col("value") * F.col("value")).alias("v"))
        m = m.crossJoin(F.broadcast(rho)).select("group", ratio("e", "rho").alias("e"), ratio(F.col("v"), F.col("rho") * F.col("rho")).alias("v")).join(top, "group")
        exp, nu, a = F.col("ps") * F.col("e"), F.col("ps") * F.col("ps") * F.col("v"), F.col("ps") * F.col("top")
    else:
        m = scores.groupBy("group").agg(F.sum("value").alias("e"), F.sum(F.col("value") * F.col("value")).alias("v")).join(top, "group")
        exp, nu, a = F.col("ps") * F.col("e"), F.col("ps") * F.col("v"), F.col("top")
    obs = scores.join(F.broadcast(sets), "feature_id").groupBy("set_name", "group").agg(F.sum("value").alias("o"))
    grid = size.crossJoin(F.broadcast(m)).join(obs, ["set_name", "group"], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    return grid.select("set_name", "group", chernoff(F.col("o"), exp, nu, a).alias("value"))


def prefix_enrichment(scores: DataFrame, sets: DataFrame, n_rows: int, top_length: int = 1000) -> DataFrame:
    """(set_name, group, value): the largest bound over prefixes of each group's features by score.

    A bound can only grow at a member of the set, so sums run over the ranked features once and are
    joined with members alone, not with every set and feature."""
    sets = sets.distinct()
    size = sets.groupBy("set_name").agg((F.count("*") / F.lit(float(n_rows))).alias("ps"))
    order = Window.partitionBy("group").orderBy(F.desc(F.round("value", 9)), "feature_id")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_length)
    ranked = ranked.withColumn("s1", F.sum("value").over(run)).withColumn("s2", F.sum(F.col("value") * F.col("value")).over(run))
    top = scores.groupBy("group").agg(F.greatest(F.max("value"), F.lit(0.0)).alias("a"))
    hits = ranked.join(F.broadcast(sets), "feature_id")
    inside = Window.partitionBy("group", "set_name").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("o", F.sum("value").over(inside)).join(F.broadcast(size), "set_name").join(F.broadcast(top), "group")
    bound = chernoff(F.col("o"), F.col("ps") * F.col("s1"), F.col("ps") * F.col("s2"), F.col("a"))
    best = hits.groupBy("set_name", "group").agg(F.max(bound).alias("value"))
    grid = size.select("set_name").crossJoin(F.broadcast(top.select("group")))
    return grid.join(best, ["set_name", "group"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def double_norm(table: DataFrame, row: str, col: str, least: float = 0.0, log_above: float | None = 100.0) -> DataFrame:
    """Values under ``least`` as 0, log1p if the largest exceeds ``log_above``, divided by the roots of row
    and column sums, then by the largest."""
    v = table.withColumn("value", F.when(F.col("value") < least, 0.0).otherwise(F.col("value")))
    if log_above is not None:
        top = v.agg(F.max("value").alias("__top"))
        v = v.crossJoin(F.broadcast(top)).withColumn("value", F.when(F.col("__top") > log_above, F.log1p("value")).otherwise(F.col("value"))).drop("__top")
    rs, cs = F.sum("value").over(Window.partitionBy(row)), F.sum("value").over(Window.partitionBy(col))
    v = v.withColumn("__r", F.when(rs == 0, 1.0).otherwise(rs)).withColumn("__c", F.when(cs == 0, 1.0).otherwise(cs))
    v = v.withColumn("value", F.col("value") / F.sqrt("__r") / F.sqrt("__c")).drop("__r", "__c")
    top = v.agg(F.max("value").alias("__top"))
    return v.crossJoin(F.broadcast(top)).withColumn("value", ratio("value", "__top")).drop("__top")


def log_mean_exp(scores: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """(by, value): ln of the mean of 10^value over the ``top`` highest values (all by default)."""
    x = scores.select(by, "value")
    if top is not None:
        w = Window.partitionBy(by).orderBy(F.desc("value"))
        x = x.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top)
    high = F.max("value").over(Window.partitionBy(by))
    x = x.withColumn("__m", high)
    n = F.lit(float(top)) if top is not None else F.count("*").cast("double")
    return x.groupBy(by).agg((LN10 * F.first("__m") + F.ln(F.sum(F.exp(LN10 * (F.col("value") - F.col("__m"))))) - F.ln(n)).alias("value"))


def participation_ratio(assay: DataFrame, by: str) -> DataFrame:
    """(by, value): (sum x^2)^2 / sum x^4, the effective number of entries."""
    q = F.col("value") * F.col("value")
    return assay.groupBy(by).agg(F.sum(q).alias("s2"), F.sum(q * q).alias("s4")).select(by, ratio(F.col("s2") * F.col("s2"), F.col("s4")).alias("value"))


def robust_z(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``z``: (x - median) / (1.4826 MAD), by the deviation where MAD is 0, else 0."""
    mid = rows.groupBy(by).agg(F.median("value").alias("med"), F.stddev_samp("value").alias("sd"))
    a = rows.join(F.broadcast(mid), by)
    mad = a.groupBy(by).agg((1.4826 * F.median(F.abs(F.col("value") - F.col("med")))).alias("mad"))
    scale = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("sd"))
    return a.join(F.broadcast(mad), by).withColumn("z", ratio(F.col("value") - F.col("med"), scale)).drop("med", "sd", "mad")


def benjamini_hochberg(rows: DataFrame, p: str = "p", by: str | None = None) -> DataFrame:
    """``rows`` with ``fdr``: the smallest p m / rank over larger ranks, 1 at most."""
    part = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    up = part.orderBy(p)
    r = rows.withColumn("__rank", F.rank().over(up) + F.count("*").over(part.partitionBy(*([by] if by else [F.lit(0)]), p)) - 1).withColumn("__m", F.count("*").over(part))
    down = part.orderBy(F.desc("__rank")).rangeBetween(Window.unboundedPreceding, 0)
    return r.withColumn("fdr", F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(down))).drop("__rank", "__m")


def harmonic_p(rows: DataFrame, by: str, p: str = "p") -> DataFrame:
    """(by, p): the harmonic mean of p-values, each at least 1e-300."""
    return rows.groupBy(by).agg((F.count("*") / F.sum(1.0 / F.greatest(F.col(p), F.lit(1e-300)))).alias("p"))


def welch_t(rows: DataFrame, labels: DataFrame, by: str = "dim", least: int = 3) -> DataFrame:
    """(by, label, n, t): Welch's t of dense ``rows(cell_id, by, value)`` inside a label against outside, 0
    if either side has fewer than ``least`` cells. The outside is the total minus the inside, so rows
    are read once whatever the number of labels."""
    x, q = F.col("value"), F.col("value") * F.col("value")
    inside = rows.join(labels.select("cell_id", "label").where("label is not null"), "cell_id").groupBy(by, "label").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(q).alias("q"))
    known = rows.join(labels.where("label is not null").select("cell_id"), "cell_id", "left_semi")
    total = known.groupBy(by).agg(F.count("*").alias("tn"), F.sum(x).alias("ts"), F.sum(q).alias("tq"))
    a = inside.join(total, by).withColumn("m", F.col("tn") - F.col("n"))

    def var(n, s, q2):
        return ratio(q2 - s * s / F.when(n > 0, n), n - 1)

    c = F.col
    v1, v0 = var(c("n"), c("s"), c("q")), var(c("m"), c("ts") - c("s"), c("tq") - c("q"))
    delta = c("s") / c("n") - ratio(c("ts") - c("s"), c("m").cast("double"))
    t = ratio(delta, F.sqrt(F.greatest(F.lit(0.0), v1 / c("n") + ratio(v0, c("m").cast("double")))))
    return a.select(by, "label", "n", F.when((c("n") < least) | (c("m") < least), 0.0).otherwise(t).alias("t"))


def phenotype_enrichment(h: DataFrame, weights: DataFrame) -> DataFrame:
    """(arch, z): (sum of r w - half the sum of w) / sqrt(sum of w^2 / 12), r the rank of a cell in its
    archetype's ``h(cell_id, arch, value)`` scaled to (0, 1], for ``weights(cell_id, weight)``."""
    order = Window.partitionBy("arch").orderBy("value", "cell_id")
    n = F.count("*").over(Window.partitionBy("arch"))
    r = h.join(weights, "cell_id").withColumn("r", F.row_number().over(order) / n)
    s = r.groupBy("arch").agg(F.sum(F.col("r") * F.col("weight")).alias("rw"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("weight")).alias("w2"))
    return s.select("arch", ratio(F.col("rw") - 0.5 * F.col("w"), F.sqrt(F.col("w2") / 12.0)).alias("z"))


def set_score_z(scores: DataFrame, sets: DataFrame, n_rows: int) -> DataFrame:
    """(set_name, group, z): sums of signed members against random sets of that size without replacement,
    by the exact mean and variance. ``sets`` may have a ``direction``."""
    d = F.col("direction") if "direction" in sets.columns else F.lit(1)
    members = sets.withColumn("direction", d).select("set_name", "feature_id", "direction").distinct()
    m = scores.groupBy("group").agg((F.sum("value") / F.lit(float(n_rows))).alias("mu"), F.sum(F.col("value") * F.col("value")).alias("q"))
    size = members.groupBy("set_name").agg(F.sum("direction").alias("ds"), F.count("*").alias("k"))
    obs = scores.join(F.broadcast(members), "feature_id").groupBy("set_name", "group").agg(F.sum(F.col("value") * F.col("direction")).alias("o"))
    grid = size.crossJoin(F.broadcast(m)).join(obs, ["set_name", "group"], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    n = F.lit(float(n_rows))
    s2 = (F.col("q") - n * F.col("mu") * F.col("mu")) / (n - 1)
    var = s2 * (F.col("k") - F.col("ds") * F.col("ds") / n)
    return grid.select("set_name", "group", ratio(F.col("o") - F.col("mu") * F.col("ds"), F.sqrt(F.greatest(F.lit(0.0), var))).alias("z"))
