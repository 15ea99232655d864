"""The whole analysis: from counts to states, graph, layout, specificity and colours."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import decompose, graph, labels, layout, normalize, specificity
from quillon.sources.matrix import Experiment
from quillon.tables import materialize


@dataclass
class Analysis:
    """Results by name; every entry is a frame or a frame by name."""

    archetypes: dict[str, DataFrame]
    edges: DataFrame
    edges_in: DataFrame
    coords: DataFrame
    colors: DataFrame
    states: dict[str, DataFrame]
    specificity: DataFrame
    connectivity: DataFrame
    annotations: DataFrame | None = None
    metadata: dict[str, Any] = field(default_factory=dict)


def reduce(data: Experiment, method: str = "default", dims: int = 50, iterations: int = 5) -> Experiment:
    """``data`` with normalized counts, unless it has them, and reduced vectors under "S_r"."""
    n_features, n_cells = data.features.count(), data.cells.count()
    if "logcounts" not in data.assays:
        data = data.with_assay("logcounts", materialize(normalize.normalize(data.assay("counts"), method, n_cells), "logcounts"))
    vectors, loadings, explained = decompose.reduce_expression(data.assay("logcounts"), n_features, n_cells, dims, iterations)
    return Experiment(data.assays, data.features, data.cells, {**data.reduced, "S_r": vectors, "V": loadings}, {**data.metadata, "explained": explained.tolist()})


def build_graph(h: DataFrame, method: str = "AND", spread: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(symmetric edges, edges normalized into dst) of the adaptive graph of cells by H (arch, cell_id, value)."""
    total = h.groupBy("cell_id").agg(F.sum("value").alias("t"))
    archs = [r["arch"] for r in h.select("arch").distinct().orderBy("arch").collect()]
    wide = h.join(total, "cell_id").groupBy("cell_id").pivot("arch", archs).agg(F.sum(F.col("value") / F.col("t")))
    vectors = materialize(wide.select("cell_id", F.array(*[F.coalesce(F.col(f"`{a}`"), F.lit(0.0)) for a in archs]).alias("p")), "simplex")
    k = graph.neighbour_count(vectors.count())
    directed = materialize(graph.adaptive_edges(graph.nearest(vectors, k), spread), "directed")
    return materialize(graph.symmetrize(directed, method), "edges"), materialize(graph.normalize_in(directed), "edges-in")


def run(data: Experiment, k_min: int = 2, k_max: int = 30, method: str = "AND", spread: float = 1.0, z_threshold: float = -1.0, compactness: float = 50.0, epochs: int = 500, batches: DataFrame | None = None, resolution: float = 1.5, rounds: int = decompose.ROUNDS) -> Analysis:
    """Everything, from an experiment with reduced vectors."""
    if "S_r" not in data.reduced:
        raise ValueError("reduce the experiment first")
    cells, counts = data.reduced["S_r"], data.assay("logcounts", "counts")
    n_cells, n_features = data.cells.count(), data.features.count()
    dims = cells.select(F.size("vec")).first()[0]
    c, h = decompose.archetypes(cells, k_min, k_max, batches, rounds=rounds)
    stacked = decompose.reconstruct(counts, c, h, n_cells, z_threshold)
    edges, edges_in = build_graph(stacked["h"], method, spread)
    coords = materialize(layout.layout(edges, cells, compactness, epochs), "coords")
    colors = materialize(layout.cell_colors(coords), "colors")
    states = decompose.unify(cells, stacked["c"], dims, resolution)
    groups = stacked["c"].select("cell_id", F.col("arch").alias("group"), F.col("value").alias("weight"))
    scores = specificity.feature_specificity(counts, groups, n_features, n_cells)
    assigned = states["assignments"].select(F.col("cell_id").alias("v"), F.col("state").alias("label"))
    strength = graph.connectivity(edges, cells.select(F.col("cell_id").alias("v")), assigned)
    return Analysis(stacked, edges, edges_in, coords, colors, states, scores, strength)


def rerun_layout(result: Analysis, cells: DataFrame, compactness: float = 50.0, epochs: int = 500) -> Analysis:
    coords = materialize(layout.layout(result.edges, cells, compactness, epochs), "coords")
    return Analysis(result.archetypes, result.edges, result.edges_in, coords, materialize(layout.cell_colors(coords), "colors"), result.states, result.specificity, result.connectivity, result.annotations)


def rebuild(result: Analysis, cells: DataFrame, method: str = "AND", spread: float = 1.0, **options) -> Analysis:
    """Graph and layout anew from the stacked archetypes."""
    edges, edges_in = build_graph(result.archetypes["h"], method, spread)
    again = Analysis(result.archetypes, edges, edges_in, result.coords, result.colors, result.states, result.specificity, result.connectivity, result.annotations)
    return rerun_layout(again, cells, **options)


def subset(data: Experiment, result: Analysis, states: list[int], **options) -> Analysis:
    """The analysis of the cells assigned to some states."""
    keep = materialize(result.states["assignments"].where(F.col("state").isin(states)).select("cell_id"), "subset")
    inner = {n: a.join(keep, "cell_id", "left_semi") for n, a in data.assays.items()}
    reduced = {n: a.join(keep, "cell_id", "left_semi") if "cell_id" in a.columns else a for n, a in data.reduced.items()}
    return run(Experiment(inner, data.features, data.cells.join(keep, "cell_id", "left_semi"), reduced, data.metadata), **options)


def impute(edges: DataFrame, assay: DataFrame, features: DataFrame, alpha: float = 0.85, max_it: int = 5, prune: bool = False, rescale: bool = True) -> DataFrame:
    """(feature_id, cell_id, value): features diffused over the graph, scaled back to their largest value.
    With ``prune``, cells outside each feature's cut of least conductance become 0."""
    x = materialize(assay.join(F.broadcast(features.select("feature_id")), "feature_id", "left_semi").where("value > 0"), "impute")
    start = x.select(F.col("feature_id").alias("key"), F.col("cell_id").alias("v"), "value")
    y = graph.pagerank(edges, start, start.select("v").distinct(), alpha, max_it)
    if prune:
        kept = graph.least_cut(edges, y.withColumnRenamed("value", "score"))
        y = y.join(kept, ["key", "v"], "left_semi")
    if rescale:
        top, most = x.groupBy("feature_id").agg(F.max("value").alias("top")), y.groupBy("key").agg(F.max("value").alias("most"))
        y = y.join(F.broadcast(top.withColumnRenamed("feature_id", "key")), "key").join(F.broadcast(most), "key")
        y = y.withColumn("value", F.when(F.col("most") > 0, F.least("top", F.col("value") * F.col("top") / F.when(F.col("most") > 0, F.col("most")))).otherwise(0.0))
    return y.select(F.col("key").alias("feature_id"), F.col("v").alias("cell_id"), "value")


def impute_by_states(profile: DataFrame, h_core: DataFrame, features: DataFrame) -> DataFrame:
    """(feature_id, cell_id, value): state profiles (feature_id, arch, value) mixed by each cell's states."""
    p = profile.join(F.broadcast(features.select("feature_id")), "feature_id", "left_semi").withColumnRenamed("value", "p")
    return h_core.join(F.broadcast(p), "arch").groupBy("feature_id", "cell_id").agg(F.sum(F.col("value") * F.col("p")).alias("value"))


def set_activity(edges: DataFrame, assay: DataFrame, features: DataFrame, alpha: float = 0.9) -> DataFrame:
    """(cell_id, value): the mean of the imputed features."""
    n = features.select("feature_id").distinct().count()
    return impute(edges, assay, features, alpha).groupBy("cell_id").agg((F.sum("value") / F.lit(float(max(n, 1)))).alias("value"))


def prune_scores(edges: DataFrame, scores: DataFrame, alpha: float = 0.9) -> DataFrame:
    """(v, score): scores clipped at 0, diffused, and 0 outside the cut of least conductance."""
    start = scores.select(F.lit(0).alias("key"), "v", F.greatest("score", F.lit(0.0)).alias("value"))
    y = graph.pagerank(edges, start, scores.select("v"), alpha, 5).withColumnRenamed("value", "score")
    inside = graph.least_cut(edges, y).withColumn("inside", F.lit(True))
    return y.join(inside, ["key", "v"], "left").select("v", F.when(F.col("inside"), F.col("score")).otherwise(0.0).alias("score"))


def archetype_cells(edges: DataFrame, h: DataFrame, arch: int, alpha: float = 0.9) -> DataFrame:
    """Cells that belong with an archetype: exp(h / mean h), pruned."""
    one = h.where(F.col("arch") == arch).select(F.col("cell_id").alias("v"), "value")
    mean = one.agg(F.avg("value").alias("m"))
    score = one.crossJoin(F.broadcast(mean)).select("v", F.exp(F.col("value") / F.col("m")).alias("score"))
    return prune_scores(edges, score, alpha).where("score > 0")


def cluster(edges: DataFrame, vertices: DataFrame, resolution: float = 0.5, start: DataFrame | None = None) -> DataFrame:
    """(cell_id, label, label_name): communities of the graph, from given labels if there are any."""
    from quillon.operators.filters import recode_labels

    found = graph.communities(edges, vertices, resolution, start=start)
    coded = recode_labels(found.select(F.col("v").alias("cell_id"), "label"))
    return coded.withColumn("label_name", F.concat(F.lit("Cluster "), F.col("label")))


def annotate_cells(edges: DataFrame, assay: DataFrame, markers: DataFrame, alpha: float = 0.9) -> DataFrame:
    """(cell_id, label, confidence): markers imputed over the graph, then scored in each cell."""
    genes = markers.select("feature_id").distinct()
    x = impute(edges, assay, genes, alpha)
    scores = x.select("feature_id", F.col("cell_id").alias("group"), "value")
    return labels.annotate_by_markers(scores, markers, genes.count()).withColumnRenamed("group", "cell_id")


def feature_network(scores: DataFrame, interactome: DataFrame, least: float = 2.0) -> DataFrame:
    """(group, src, dst, weight): interactions between features scored in each group, a documented stand-in
    for a sampling method: scores become normal quantiles of their ranks, and an edge has its own weight
    times the joint tail -log10 of both ends; those under ``least`` go."""
    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        from statistics import NormalDist

        return p.map(NormalDist().inv_cdf)

    w = Window.partitionBy("group")
    r = scores.withColumn("r", (F.rank().over(w.orderBy("value")) - 0.5) / F.count("*").over(w)).select("feature_id", "group", quantile("r").alias("z"))
    e = interactome.where("src < dst").join(F.broadcast(r.toDF("src", "group", "zs")), "src").join(F.broadcast(r.toDF("dst", "group2", "zd")), "dst").where("group = group2")
    low = F.least("zs", "zd")
    tail = -F.log10(1.0 / (1.0 + F.exp(1.702 * low)))
    return e.select("group", "src", "dst", (F.col("weight") * 2 * tail).alias("weight")).where(F.col("weight") >= least)
