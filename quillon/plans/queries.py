"""Registered queries over the driver's tables: each applies one operator to its whole table.

Counts are quantities of parts by supplier; labels are suppliers' nations; sets are parts by brand; the
cells of graphs are the embedding vectors, as simplex vectors of absolute values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import color
from quillon.functions.scalars import rounded
from quillon.operators import annotate, decompose, filters, graph, labels, layout, linalg, normalize, specificity
from quillon.sources import matrix
from quillon.tables import materialize, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rows(df: DataFrame, *keys: str, **values) -> DataFrame:
    """``keys`` and rounded ``values`` (a column or (column, digits))."""
    return df.select(*keys, *[rounded(*(v if isinstance(v, tuple) else (v,))).alias(n) for n, v in values.items()])


# --- tables -------------------------------------------------------------------------------------------


def counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("cell_id")).agg(F.sum("l_quantity").alias("value"))


def sizes(spark: SparkSession, d: str) -> tuple[int, int]:
    return table(spark, d, "part").count(), table(spark, d, "supplier").count()


def nations(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("cell_id"), F.col("n_name").alias("label"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("s_suppkey").alias("cell_id"), F.col("r_name").alias("label"))


def brands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("set_name"), F.col("p_partkey").alias("feature_id"))


def lognorm(spark: SparkSession, d: str) -> DataFrame:
    return normalize.median_log1p(counts(spark, d))


def nation_sums(spark: SparkSession, d: str) -> DataFrame:
    """Normalized values of parts summed by nation: (feature_id, group, value)."""
    return lognorm(spark, d).join(F.broadcast(nations(spark, d)), "cell_id").groupBy("feature_id", F.col("label").alias("group")).agg(F.sum("value").alias("value"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"))


def vector_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), "label")


def dims(spark: SparkSession, d: str) -> DataFrame:
    """(cell_id, dim, value)."""
    return linalg.dense(vectors(spark, d), "cell_id", "vec")


def simplex(spark: SparkSession, d: str) -> DataFrame:
    return graph.simplex_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")


def directed(spark: SparkSession, d: str) -> DataFrame:
    """Lists of edges by dst."""
    p = materialize(simplex(spark, d), "simplex")
    return graph.adaptive_lists(p, graph.neighbour_count(p.count()))


def mutual(spark: SparkSession, d: str, method: str = "AND") -> DataFrame:
    """Lists of edges by dst."""
    p = materialize(simplex(spark, d), "simplex")
    return graph.mutual_lists(p, graph.neighbour_count(p.count()), method)


def linked(spark: SparkSession, d: str) -> DataFrame:
    """The graph in both directions, as lists."""
    return materialize(mutual(spark, d), "graph", "zstd")


def undirected(spark: SparkSession, d: str) -> DataFrame:
    """The graph in both directions, as edges."""
    return graph.outgoing(linked(spark, d))


# --- sources and filters ------------------------------------------------------------------------------


@query
def coo_counts(spark, d):
    return counts(spark, d)


@query
def prefilter(spark, d):
    return filters.prefilter(counts(spark, d), sizes(spark, d)[1], 0.25, 250)


@query
def event_counts(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("feature_id"), F.col("user_id").alias("cell_id")).agg(F.count("*").cast("double").alias("value"))


@query
def binarize(spark, d):
    return filters.binarize(counts(spark, d))


@query
def threshold(spark, d):
    return filters.threshold(counts(spark, d), 30.0)


@query
def blacklist_filter(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("feature_id"))
    return filters.drop_blacklisted(p, pattern="green|^b|1$")


@query
def set_size_filter(spark, d):
    some = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("feature_id"))
    return filters.filter_sets(brands(spark, d), some, 3, 45)


@query
def signed_markers(spark, d):
    p = table(spark, d, "part")
    sign = F.when(F.col("p_size") % 3 == 0, "+").when(F.col("p_size") % 3 == 1, "-").otherwise("")
    return filters.parse_markers(p.select(F.col("p_brand").alias("celltype"), F.concat("p_name", sign).alias("marker")))


@query
def normalize_labels(spark, d):
    return filters.normalize_labels(nations(spark, d).withColumnRenamed("label", "label_name"))


@query
def recode_labels(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_nationkey") * 10 + 7).cast("int").alias("label"))
    return filters.recode_labels(s)


@query
def convert_feature_ids(spark, d):
    p = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("name"))
    x = counts(spark, d)
    return matrix.convert_feature_ids(x, p).groupBy("feature_id").agg(F.sum("value").alias("value"))


@query
def supported_archetypes(spark, d):
    c = dims(spark, d).select(F.col("dim").alias("arch"), "cell_id", F.col("value") - 0.1).toDF("arch", "cell_id", "value")
    return filters.supported_archetypes(c, 60)


@query
def remove_cells(spark, d):
    c = counts(spark, d).withColumnRenamed("feature_id", "arch")
    gone = table(spark, d, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("cell_id"))
    return rows(filters.remove_cells({"c_matrix": c}, gone)["c_matrix"], "arch", "cell_id", value=("value", 10))


# --- normalization and algebra ------------------------------------------------------------------------


@query
def norm_median_log1p(spark, d):
    return rows(lognorm(spark, d), "feature_id", "cell_id", value="value")


@query
def norm_logcpm(spark, d):
    return rows(normalize.log_cpm(counts(spark, d)), "feature_id", "cell_id", value="value")


@query
def norm_median_ratio(spark, d):
    e = event_counts(spark, d)
    return rows(normalize.median_ratio(e, e.select("cell_id").distinct().count()), "feature_id", "cell_id", value="value")


@query
def norm_median_ratio_factors(spark, d):
    part = counts(spark, d).join(regions(spark, d), "cell_id").groupBy("feature_id", F.col("label").alias("cell_id")).agg(F.sum("value").alias("value"))
    return rows(normalize.median_ratio_factors(part, 5), "cell_id", factor="factor")


@query
def norm_cluster_factors(spark, d):
    return rows(normalize.cluster_factors(counts(spark, d), nations(spark, d)), "feature_id", "cell_id", value="value")


@query
def norm_trimmed_mean_factors(spark, d):
    return rows(normalize.trimmed_mean_factors(counts(spark, d)), "cell_id", factor="factor")


@query
def l1_normalize(spark, d):
    return rows(linalg.l1_normalize(counts(spark, d)), "feature_id", "cell_id", value=("value", 9))


@query
def l2_normalize(spark, d):
    return rows(linalg.l2_normalize(counts(spark, d)), "feature_id", "cell_id", value=("value", 9))


@query
def zscore(spark, d):
    return rows(linalg.zscore(dims(spark, d)), "cell_id", "dim", value="value")


@query
def marginals(spark, d):
    return rows(linalg.marginals(counts(spark, d), "feature_id", sizes(spark, d)[1]), "feature_id", "nnz", total="total", squares="squares", mean="mean", top="top")


@query
def spmm(spark, d):
    w = nations(spark, d).select("cell_id", "label", F.lit(1.0).alias("value"))
    return rows(linalg.product(lognorm(spark, d), w, "cell_id", "feature_id", "label"), "feature_id", "label", value="value")


@query
def col_correlation(spark, d):
    return rows(linalg.correlation(counts(spark, d), "feature_id", "cell_id", sizes(spark, d)[0]), "a", "b", value="value")


@query
def cross_product(spark, d):
    n = nation_sums(spark, d).groupBy("group").agg(F.sum("value").alias("t"))
    return rows(linalg.outer(n.toDF("row", "p"), n.toDF("col", "q")), "row", "col", value=("value", 2))


# --- specificity and enrichment -----------------------------------------------------------------------


def _specificity(spark, d, groups):
    f, c = sizes(spark, d)
    return specificity.feature_specificity(lognorm(spark, d), groups.select("cell_id", F.col("label").alias("group"), F.lit(1.0).alias("weight")), f, c)


@query
def feature_specificity(spark, d):
    return rows(_specificity(spark, d, nations(spark, d)), "feature_id", "group", profile="profile", significance="significance")


@query
def specificity_pairwise(spark, d):
    y = lognorm(spark, d)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_acctbal") > 0).alias("case"))
    case, control = (y.join(s.where(c).select("cell_id"), "cell_id", "left_semi") for c in ("case", "not case"))
    n = {r["case"]: r["count"] for r in s.groupBy("case").count().collect()}
    groups = nations(spark, d).join(s.where("case").select("cell_id"), "cell_id", "left_semi").select("cell_id", F.col("label").alias("group"), F.lit(1.0).alias("weight"))
    out = specificity.feature_specificity(case, groups, sizes(spark, d)[0], n.get(True, 0), control, n.get(False, 0))
    return rows(out, "feature_id", "group", up="significance", down="down")


@query
def top_markers(spark, d):
    return rows(specificity.top_features(_specificity(spark, d, nations(spark, d)), 5), "group", "feature_id", "rank", significance="significance")


@query
def differential_scores(spark, d):
    return rows(specificity.differential_scores(_specificity(spark, d, regions(spark, d)), 3), "feature_id", "group", significance="significance")


@query
def chernoff_enrichment(spark, d):
    return rows(specificity.chernoff_enrichment(nation_sums(spark, d), brands(spark, d), sizes(spark, d)[0]), "set_name", "group", value="value")


@query
def chernoff_no_row_scaling(spark, d):
    return rows(specificity.chernoff_enrichment(nation_sums(spark, d), brands(spark, d), sizes(spark, d)[0], False), "set_name", "group", value="value")


@query
def geneset_enrichment(spark, d):
    s = _specificity(spark, d, nations(spark, d)).select("feature_id", "group", F.log1p("significance").alias("value"))
    return rows(specificity.chernoff_enrichment(s, filters.filter_sets(brands(spark, d), s, 3, 500), sizes(spark, d)[0], False), "set_name", "group", value="value")


@query
def geneset_enrichment_prefix(spark, d):
    s = _specificity(spark, d, regions(spark, d)).select("feature_id", "group", F.col("significance").alias("value"))
    return rows(specificity.prefix_enrichment(s, brands(spark, d), sizes(spark, d)[0], 1000), "set_name", "group", value="value")


@query
def double_norm(spark, d):
    e = nation_sums(spark, d).join(F.broadcast(brands(spark, d)), "feature_id").groupBy("set_name", "group").agg(F.sum("value").alias("value"))
    return rows(specificity.double_norm(e, "set_name", "group"), "set_name", "group", value="value")


@query
def log_mean_exp(spark, d):
    e = specificity.chernoff_enrichment(nation_sums(spark, d), brands(spark, d), sizes(spark, d)[0], False)
    return rows(specificity.log_mean_exp(e, "group", 5), "group", value="value")


@query
def participation_ratio(spark, d):
    return rows(specificity.participation_ratio(counts(spark, d), "feature_id"), "feature_id", value="value")


@query
def robust_z(spark, d):
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_acctbal").alias("value")).join(regions(spark, d), "cell_id")
    return rows(specificity.robust_z(x, "label"), "cell_id", "label", z="z")


@query
def label_overlap_hgt(spark, d):
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.floor(F.col("s_acctbal") / 2000).cast("long").alias("label"))
    return rows(labels.overlap(nations(spark, d), b), "label_a", "label_b", "n", value="value")


@query
def welch_t_by_label(spark, d):
    l = vector_labels(spark, d).withColumnRenamed("v", "cell_id")
    return rows(specificity.welch_t(dims(spark, d), l), "dim", "label", "n", t="t")


@query
def harmonic_p_bh(spark, d):
    l = vector_labels(spark, d).withColumnRenamed("v", "cell_id")
    t = specificity.welch_t(dims(spark, d), l).withColumn("p", F.exp(-F.abs("t")))
    return rows(specificity.benjamini_hochberg(specificity.harmonic_p(t, "dim")), "dim", p="p", fdr="fdr")


@query
def phenotype_enrichment_analytic(spark, d):
    h = dims(spark, d).select("cell_id", F.col("dim").alias("arch"), "value")
    w = dims(spark, d).where("dim = 20").select("cell_id", F.abs("value").alias("weight"))
    return rows(specificity.phenotype_enrichment(h, w), "arch", z="z")


@query
def marker_z(spark, d):
    return rows(specificity.set_score_z(nation_sums(spark, d), brands(spark, d), sizes(spark, d)[0]), "set_name", "group", z="z")


# --- graphs -------------------------------------------------------------------------------------------


@query
def jsd_pairs(spark, d):
    return rows(graph.jsd_pairs(simplex(spark, d)), "a", "b", distance="distance")


@query
def knn_jsd(spark, d):
    return rows(graph.nearest(simplex(spark, d), 20), "cell_id", "neighbour", "rank", distance="distance")


@query
def kstar_graph(spark, d):
    return rows(graph.unroll(directed(spark, d)), "src", "dst", weight="weight")


@query
def graph_and(spark, d):
    return rows(graph.unroll(mutual(spark, d)), "src", "dst", weight="weight")


@query
def graph_or(spark, d):
    return rows(graph.unroll(mutual(spark, d, "OR")), "src", "dst", weight="weight")


@query
def graph_asym(spark, d):
    return rows(graph.unroll(graph.normalize_lists(directed(spark, d))), "src", "dst", weight=("weight", 9))


@query
def double_stochastic(spark, d):
    return graph.double_stochastic(linked(spark, d), digits=9)


def _label_start(spark, d):
    l = vector_labels(spark, d)
    n = l.groupBy("label").agg(F.count("*").alias("n"))
    return l.join(n, "label").select(F.col("label").alias("key"), "v", (1.0 / F.col("n")).alias("value"))


@query
def pagerank_step(spark, d):
    x = _label_start(spark, d)
    return rows(graph.pagerank_step(linked(spark, d), x, x, x.select("v")), "key", "v", value=("value", 9))


@query
def impute_step(spark, d):
    from quillon.plans.pipeline import impute

    x = dims(spark, d).select(F.col("dim").alias("feature_id"), "cell_id", F.greatest(F.col("value"), F.lit(0.0)).alias("value"))
    return rows(impute(linked(spark, d), x, x.select("feature_id").distinct(), max_it=1), "feature_id", "cell_id", value="value")


@query
def sweep_cut(spark, d):
    s = dims(spark, d).select(F.col("dim").alias("key"), F.col("cell_id").alias("v"), F.col("value").alias("score"))
    cut = graph.sweep_cut(linked(spark, d), s).where("conductance < double('Infinity')")
    return rows(cut, "key", "v", "rank", conductance="conductance")


@query
def moran_backbone(spark, d):
    h = dims(spark, d).select("cell_id", F.col("dim").alias("arch"), "value")
    p = materialize(simplex(spark, d), "simplex")
    n = p.count()
    return rows(graph.moran_backbone(graph.adaptive_shares(p, graph.neighbour_count(n)), h, n), "a", "b", value="value")


@query
def geary_autocorrelation(spark, d):
    x = dims(spark, d).select(F.col("dim").alias("key"), F.col("cell_id").alias("v"), "value")
    return rows(graph.geary(linked(spark, d), x), "key", c="c", autocorrelation="autocorrelation")


@query
def categorical_phi_z(spark, d):
    return rows(graph.categorical_phi(linked(spark, d), vector_labels(spark, d)), phi=("phi", 2), mean=("mean", 2), z=("z", 4), log_p=("log_p", 3))


@query
def label_local_enrichment(spark, d):
    return rows(labels.local_enrichment(graph.double_stochastic(undirected(spark, d), False), vector_labels(spark, d)), "v", "label", value="value")


@query
def infer_missing_step(spark, d):
    l = vector_labels(spark, d).select("v", F.when(F.col("v") % 5 != 0, F.col("label")).alias("label"))
    return labels.infer_step(graph.double_stochastic(undirected(spark, d), False), l, l.count(), False)


@query
def correct_labels_step(spark, d):
    return labels.correct_step(graph.double_stochastic(undirected(spark, d), False), vector_labels(spark, d), 0.5)


@query
def transitivity(spark, d):
    x = dims(spark, d)
    c = linalg.correlation(x, "cell_id", "dim", table(spark, d, "embeddings").count()).where("value > 0")
    e = c.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("value").alias("weight")).union(c.select("b", "a", "value"))
    return rows(graph.transitivity(e), "v", value="value")


@query
def landmark_cells(spark, d):
    x = dims(spark, d)
    h = x.select("cell_id", F.col("dim").alias("arch"), F.round(F.col("value"), 1).alias("value"))
    c = x.select("cell_id", F.col("dim").alias("arch"), "value")
    return decompose.landmark_cells(c, h)


@query
def cell_scores_from_enrichment(spark, d):
    x = dims(spark, d).select("cell_id", F.col("dim").alias("arch"), F.abs("value").alias("value"))
    e = x.join(vector_labels(spark, d).withColumnRenamed("v", "cell_id"), "cell_id").groupBy("arch", "label").agg(F.avg("value").alias("value"))
    return rows(labels.cell_scores(x, e), "cell_id", "label", value="value")


@query
def annotation_wide(spark, d):
    a, b = nations(spark, d), regions(spark, d)
    store = labels.add_annotation(None, a.select("cell_id", F.lit(0).alias("label"), F.col("label").alias("label_name")), "nation")
    store = labels.add_annotation(store, b.select("cell_id", F.lit(0).alias("label"), F.col("label").alias("label_name")), "region")
    return labels.annotations_wide(store, ["nation", "region"])


@query
def set_overlap(spark, d):
    some = table(spark, d, "part").where("p_size <= 20").select(F.col("p_partkey").alias("feature_id"))
    return rows(annotate.set_overlap(some, brands(spark, d), sizes(spark, d)[0], None), "set_name", "n", value="value")


@query
def combined_activities(spark, d):
    p = table(spark, d, "part")
    kinds = p.select(F.col("p_type").alias("set_name"), F.col("p_partkey").alias("feature_id"))
    some = p.where("p_size <= 25").select(F.col("p_type").alias("set_name"), F.col("p_partkey").alias("feature_id"))
    return rows(annotate.combined_activities(nation_sums(spark, d), {"all": kinds, "small": some}, sizes(spark, d)[0]), "group", "set_name", value="value")


@query
def annotate_clusters(spark, d):
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_nationkey") % 7).cast("long").alias("label"))
    return rows(annotate.annotate_clusters(b, regions(spark, d)), "cluster", "label", "full_name", confidence="confidence")


@query
def phenotype_features(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_acctbal") > 0).alias("case")).join(regions(spark, d).withColumnRenamed("label", "cluster"), "cell_id")
    return rows(annotate.phenotype_features(lognorm(spark, d), s), "cluster", "feature_id", log_fc="log_fc", t="t", p="p", fdr="fdr")


@query
def selected_means(spark, d):
    some = table(spark, d, "part").where("p_size <= 5").select(F.col("p_partkey").alias("feature_id"))
    return rows(annotate.selected_means(lognorm(spark, d), nations(spark, d), some), "feature_id", "label", value="value")


@query
def signature_profile(spark, d):
    v = vectors(spark, d)
    load = v.select(F.col("cell_id").alias("feature_id"), "vec")
    c = table(spark, d, "embeddings").select(F.col("label").alias("arch"), F.col("vec_id").alias("cell_id"), F.lit(0.01).alias("value"))
    return rows(annotate.signature_profile(load, v, c), "feature_id", "arch", value="value")


# --- colours ------------------------------------------------------------------------------------------


def _rgb(spark, d):
    v = F.col("vec")
    return vectors(spark, d).select("cell_id", *[F.least(F.lit(1.0), F.abs(v[i]) * 3).alias(n) for i, n in enumerate("rgb")])


@query
def rgb_to_lab(spark, d):
    x = _rgb(spark, d)
    lab = color.rgb_to_lab((F.col("r"), F.col("g"), F.col("b")))
    return x.select("cell_id", *[rounded(v).alias(n) for v, n in zip(lab, ("l", "a", "b"), strict=True)])


@query
def lab_to_rgb(spark, d):
    v = F.col("vec")
    x = vectors(spark, d).select("cell_id", (50 + 100 * v[0]).alias("l"), (60 * v[1]).alias("a"), (60 * v[2]).alias("b"))
    rgb = color.lab_to_rgb((F.col("l"), F.col("a"), F.col("b")))
    return x.select("cell_id", *[rounded(v).alias(n) for v, n in zip(rgb, ("r", "g", "b"), strict=True)])


@query
def color_blend(spark, d):
    w = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("label").alias("group"), F.lit(1.0).alias("weight"))
    return rows(layout.blend_colors(w, _rgb(spark, d)), "group", r="r", g="g", b="b")


# --- decompositions and procedures (checked by tests against brute force) -----------------------------


@query
def svd_reduce(spark, d):
    reduced, _, _ = decompose.svd_reduce(vectors(spark, d), 10)
    return reduced


@query
def reduce_expression(spark, d):
    f, c = sizes(spark, d)
    return decompose.reduce_expression(lognorm(spark, d), f, c, 8, 3)[0]


@query
def leverage_topk(spark, d):
    return decompose.leverage_top(vectors(spark, d), 20)


@query
def spa(spark, d):
    return decompose.successive_projection(vectors(spark, d), 8)


@query
def simplex_regression(spark, d):
    p = simplex(spark, d).withColumnRenamed("p", "vec")
    return decompose.simplex_regression(p, np.eye(64)[:20] * 0.5 + 0.5 / 64)


@query
def archetypes_multi_k(spark, d):
    c, h = decompose.archetypes(simplex(spark, d).withColumnRenamed("p", "vec"), 2, 5, rounds=10)
    return c.withColumn("side", F.lit("C")).unionByName(h.withColumn("side", F.lit("H")))


@query
def reconstruct(spark, d):
    p = simplex(spark, d).withColumnRenamed("p", "vec")
    c, h = decompose.archetypes(p, 2, 5, rounds=10)
    assay = linalg.dense(p, "cell_id", "vec").select(F.col("dim").alias("feature_id"), "cell_id", "value")
    return decompose.reconstruct(assay, c, h, p.count())["profile"]


@query
def unify(spark, d):
    p = simplex(spark, d).withColumnRenamed("p", "vec")
    c, _ = decompose.archetypes(p, 2, 5, rounds=10)
    stacked = c.withColumn("arch", F.col("k") * 100 + F.col("arch")).drop("k")
    return decompose.unify(p, stacked, 64, min_cells=1)["assignments"]


@query
def pagerank(spark, d):
    x = _label_start(spark, d)
    return graph.pagerank(linked(spark, d), x, x.select("v"))


@query
def k_core(spark, d):
    return graph.k_core(linked(spark, d))


@query
def components(spark, d):
    return graph.components(graph.heavier(linked(spark, d), 0.68), vector_labels(spark, d).select("v"))


@query
def communities(spark, d):
    return graph.communities(linked(spark, d), vector_labels(spark, d).select("v"))


@query
def mwm(spark, d):
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.floor(F.col("s_acctbal") / 2000).cast("long").alias("label"))
    o = labels.overlap(nations(spark, d), b)
    return graph.max_weight_matching(o.select(F.col("label_a").alias("src"), F.col("label_b").alias("dst"), F.col("value").alias("weight")))


@query
def map_clusters(spark, d):
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_nationkey") % 7).cast("long").alias("label"))
    return labels.map_clusters(regions(spark, d), b)


@query
def spanner(spark, d):
    c = linalg.correlation(dims(spark, d), "cell_id", "dim", table(spark, d, "embeddings").count()).where("value > 0")
    return graph.spanner(c.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("value").alias("weight")), 2.0)


@query
def connectivity(spark, d):
    l = vector_labels(spark, d)
    return graph.connectivity(linked(spark, d), l.select("v"), l)


@query
def highlight(spark, d):
    return labels.highlight(linked(spark, d), vector_labels(spark, d))


@query
def layout_2d_3d(spark, d):
    return layout.layout(linked(spark, d), vectors(spark, d), epochs=50)


@query
def hash_ids(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return s.withColumn("hash", labels.hash_ids("salt")("id")).withColumn("back", labels.unhash_ids("salt")("hash"))


@query
def batch_correction(spark, d):
    b = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), (F.col("vec_id") % 3).alias("batch"))
    c, _ = decompose.archetypes(simplex(spark, d).withColumnRenamed("p", "vec"), 3, 3, b, 1, rounds=5)
    return c


@query
def mutual_neighbours(spark, d):
    b = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), (F.col("vec_id") % 2).alias("batch"))
    return decompose.mutual_neighbours_correction(vectors(spark, d), b, 5)


@query
def feature_network(spark, d):
    from quillon.plans.pipeline import feature_network as network

    c = linalg.correlation(counts(spark, d), "feature_id", "cell_id", sizes(spark, d)[0]).where("value > 0").select(F.col("a").alias("src"), F.col("b").alias("dst"), (10 * F.col("value")).alias("weight"))
    s = lognorm(spark, d).groupBy("cell_id").agg(F.sum("value").alias("value")).select(F.col("cell_id").alias("feature_id"), F.lit("all").alias("group"), "value")
    return network(s, c, 0.5)
