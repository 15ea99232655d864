"""Small cases with known answers, and invariants."""

from __future__ import annotations

import gzip
import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import color, scalars
from quillon.operators import decompose, filters, graph, labels, linalg, normalize, specificity
from quillon.sources import matrix


def pairs(spark, edges):
    return spark.createDataFrame([e for a, b, w in edges for e in ((a, b, w), (b, a, w))], "src long, dst long, weight double")


PATH = [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0)]


def test_simplex_regression_beats_every_vertex_and_random_mixture():
    rng = np.random.default_rng(0)
    a, b = rng.random((5, 8)), rng.random((20, 8))
    x = decompose.simplex_least_squares(a, b)
    assert np.allclose(x.sum(1), 1) and (x >= 0).all()
    best = ((x @ a - b) ** 2).sum(1)
    for other in [np.eye(5)[[k] * 20] for k in range(5)] + [rng.dirichlet(np.ones(5), 20) for _ in range(200)]:
        assert (best <= ((other @ a - b) ** 2).sum(1) + 1e-7).all()


def test_spa_finds_corners(spark):
    rows = [(1, [0.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [1 / 3, 1 / 3, 1 / 3])]
    cells = spark.createDataFrame(rows, "cell_id long, vec array<double>")
    assert {r.cell_id for r in decompose.successive_projection(cells, 3).collect()} == {1, 2, 3}


def test_svd_against_numpy(spark):
    x = np.random.default_rng(1).standard_normal((30, 6))
    cells = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell_id long, vec array<double>")
    reduced, axes, s = decompose.svd_reduce(cells, 3)
    assert np.allclose(s, np.linalg.svd(x)[1][:3])
    got = np.stack([r.vec for r in reduced.orderBy("cell_id").collect()])
    assert np.allclose(got @ got.T, x @ axes @ axes.T @ x.T)


def test_reduction_against_dense_algebra(spark):
    rng = np.random.default_rng(2)
    x = rng.poisson(1.0, (12, 9)) + 0.0
    x[:, 0] += 1
    long = [(i, j, float(x[i, j])) for i in range(12) for j in range(9) if x[i, j]]
    assay = spark.createDataFrame(long, "feature_id long, cell_id long, value double")
    reduced, _, explained = decompose.reduce_expression(assay, 12, 9, 3, 8)
    a = x / np.maximum(np.linalg.norm(x, axis=0), 1e-300)
    mu = a.mean(1)
    v = mu / np.linalg.norm(mu)
    b1 = -a.T @ v
    dense = a + np.outer(v, b1) - (v.mean() * b1 + a.mean(0))[None, :]
    u, s, vt = np.linalg.svd(dense)
    got = np.stack([r.vec for r in reduced.orderBy("cell_id").collect()])
    want = vt[:3].T * s[:3]
    assert np.allclose(np.abs(np.linalg.norm(got, axis=0)), s[:3], rtol=1e-3)
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-3)
    assert explained[-1] <= 1 + 1e-9


def test_archetypes_are_mixtures(spark):
    x = np.random.default_rng(3).dirichlet(np.ones(4) * 0.3, 60)
    cells = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell_id long, vec array<double>")
    c, h = decompose.archetypes(cells, 2, 4, rounds=5)
    assert all(abs(r.s - 1) < 1e-6 for r in c.groupBy("k", "arch").agg(F.sum("value").alias("s")).collect())
    assert all(abs(r.s - 1) < 1e-6 for r in h.groupBy("k", "cell_id").agg(F.sum("value").alias("s")).collect())


def test_jensen_shannon_bounds(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5])], "cell_id long, p array<double>")
    d = {(r.a, r.b): r.distance for r in graph.jsd_pairs(v).collect()}
    assert d[1, 2] == pytest.approx(1) and d[1, 3] == pytest.approx(d[2, 3]) and 0 < d[1, 3] < 1
    n = {(r.cell_id, r.neighbour): r.distance for r in graph.nearest(v, 2).collect()}
    assert n[1, 2] == pytest.approx(d[1, 2]) and n[3, 1] == pytest.approx(d[1, 3], abs=1e-8)


def test_pagerank_keeps_mass(spark):
    e = pairs(spark, PATH)
    start = spark.createDataFrame([(0, 1, 1.0), (0, 9, 1.0)], "key int, v long, value double")
    v = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 9)], "v long")
    total = graph.pagerank(e, start, v, 0.85, 4).agg(F.sum("value")).first()[0]
    assert total == pytest.approx(1)


def test_core_numbers_components_and_cuts(spark):
    e = pairs(spark, [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 1.0), (6, 7, 1.0)])
    assert {r.v: r.core for r in graph.k_core(e).collect()} == {1: 2, 2: 2, 3: 2, 4: 1, 6: 1, 7: 1}
    v = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 6, 7, 8)], "v long")
    assert {r.v: r.root for r in graph.components(e, v).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6, 8: 8}
    got = {r.v: r.label for r in graph.communities(e, v).collect()}
    assert got[1] == got[2] == got[3] and got[6] == got[7] and got[6] != got[1]


def test_and_edges_are_or_edges(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.25), (2, 3, 0.8)], "src long, dst long, weight double")
    both = {(r.src, r.dst): r.weight for r in graph.symmetrize(e, "AND").collect()}
    some = {(r.src, r.dst): r.weight for r in graph.symmetrize(e, "OR").collect()}
    assert both == {(1, 2): pytest.approx(0.125**0.5), (2, 1): pytest.approx(0.125**0.5)}
    assert set(both) <= set(some) and some[3, 2] == pytest.approx(0.4)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 4), st.integers(0, 3), st.integers(0, 10_000))
def test_matching_is_best(n, more, seed):
    c = np.random.default_rng(seed).integers(0, 20, (n, n + more)).astype(float)
    got = c[np.arange(n), graph.hungarian(c)].sum()
    assert got == min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(n + more), n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**50), min_size=1, max_size=3), st.text("abcXYZ19", max_size=6), st.integers(0, 12))
def test_hash_ids_round_trip(values, salt, length):
    h = labels.HashIds(salt, length)
    text = h.encode(*values)
    assert len(text) >= length and h.decode(text) == tuple(values)


def test_colours_come_back(spark):
    x = spark.createDataFrame([(0.2, 0.5, 0.7), (0.9, 0.1, 0.4), (0.3, 0.3, 0.3)], "r double, g double, b double")
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    for space in ("yuv", "yiq", "ypbpr", "ydbdr", "ycbcr", "jpegycbcr", "hsv", "hsl", "hsi", "xyz", "lab", "luv", "lch", "cat02lms"):
        there = color.convert(rgb, f"rgb->{space}")
        y = x.select("*", *[v.alias(n) for v, n in zip(there, ("a1", "a2", "a3"), strict=True)])
        back = color.convert((F.col("a1"), F.col("a2"), F.col("a3")), f"{space}->rgb")
        for r in y.select("r", "g", "b", *[v.alias(n) for v, n in zip(back, ("x", "y", "z"), strict=True)]).collect():
            assert (r.x, r.y, r.z) == (pytest.approx(r.r, abs=2e-3), pytest.approx(r.g, abs=2e-3), pytest.approx(r.b, abs=2e-3)), space
    with pytest.raises(ValueError):
        color.convert(rgb, "rgb->nothing")


def test_markers_and_blacklist(spark):
    m = spark.createDataFrame([("t", "A+"), ("t", "B-"), ("t", "C"), ("t", "X-Y+")], "celltype string, marker string")
    assert {(r.feature_id, r.direction) for r in filters.parse_markers(m).collect()} == {("A", 1), ("B", -1), ("X-Y", 1)}
    plain = spark.createDataFrame([("t", "A"), ("t", "B")], "celltype string, marker string")
    assert {r.direction for r in filters.parse_markers(plain).collect()} == {1}
    names = spark.createDataFrame([("RPL3",), ("mt-co1",), ("CD3E",), ("A.1",)], "feature_id string")
    assert [r[0] for r in filters.drop_blacklisted(names).collect()] == ["CD3E"]


def test_empty_columns_and_rows_of_zeros(spark):
    a = spark.createDataFrame([("f", "c1", 2.0), ("g", "c2", 6.0)], "feature_id string, cell_id string, value double")
    cells = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "cell_id string")
    y = {r.cell_id: r.value for r in normalize.median_log1p(a, cells).collect()}
    assert y["c1"] == pytest.approx(np.log1p(2.0 * 2 / 2)) and y["c2"] == pytest.approx(np.log1p(2.0))
    assert linalg.correlation(a, "feature_id", "cell_id", 4).first().value == pytest.approx(np.corrcoef([2, 0, 0, 0], [0, 6, 0, 0])[0, 1])
    with pytest.raises(ValueError):
        normalize.normalize(a, "SCnorm")


def test_phi_moments_by_permutation(spark):
    rng = np.random.default_rng(5)
    edges = [(i, j, float(rng.random())) for i in range(12) for j in range(i) if rng.random() < 0.3]
    lab = [0] * 4 + [1] * 8
    e = pairs(spark, edges)
    got = graph.categorical_phi(e, spark.createDataFrame(list(enumerate(lab)), "v long, label int")).first()
    p = {0: 4 / 12, 1: 8 / 12}

    def phi(x):
        return sum(2 * w * (1 if x[i] == x[j] else -1) / p[x[i]] / p[x[j]] for i, j, w in edges)

    draws = [phi(rng.permutation(lab)) for _ in range(4000)]
    assert got.phi == pytest.approx(phi(lab)) and got["mean"] == pytest.approx(np.mean(draws), rel=0.1, abs=3)
    assert got.z == pytest.approx((phi(lab) - np.mean(draws)) / np.std(draws), abs=0.25)
    assert got.log_p == pytest.approx(-math.log10(math.erfc(got.z / math.sqrt(2)) / 2), rel=1e-6)


def test_normal_tail(spark):
    z = [-9.0, -3.0, -1.5, -1.0, 0.0, 0.3, 1.4999, 1.5001, 2.0, 5.0, 30.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(scalars.log10_normal_tail(F.col("z")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([math.log10(math.erfc(x / math.sqrt(2)) / 2) for x in z], rel=1e-9, abs=1e-12)


def test_set_score_against_permutation(spark):
    x = np.random.default_rng(6).random(30)
    scores = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate(x)], "feature_id long, group string, value double")
    sets = spark.createDataFrame([("s", i, 1 if i < 3 else -1) for i in range(5)], "set_name string, feature_id long, direction int")
    z = specificity.set_score_z(scores, sets, 30).first().z
    d = np.array([1, 1, 1, -1, -1])
    rng = np.random.default_rng(7)
    draws = [x[rng.permutation(30)[:5]] @ d for _ in range(20000)]
    assert z == pytest.approx((x[:5] @ d - np.mean(draws)) / np.std(draws), abs=0.05)


def test_matrix_market(spark, tmp_path):
    with gzip.open(tmp_path / "matrix.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n%\n3 2 3\n1 1 5\n3 2 3\n2 1 7\n")
    with gzip.open(tmp_path / "features.tsv.gz", "wt") as f:
        f.write("E1\tA\tGene Expression\nE2\tB\tGene Expression\nT1\tTag\tAntibody Capture\n")
    with gzip.open(tmp_path / "barcodes.tsv.gz", "wt") as f:
        f.write("AAA-1\nCCC-1\n")
    x = matrix.read_matrix_market(spark, f"file://{tmp_path}")
    assert {(r.feature_id, r.cell_id, r.value) for r in x.assay("counts").collect()} == {("E1_A", "AAA-1", 5.0), ("E2_B", "AAA-1", 7.0)}
    assert {(r.feature_id, r.cell_id, r.value) for r in x.reduced["Antibody Capture"].collect()} == {("T1_Tag", "CCC-1", 3.0)}


def test_delimited_table(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("gene\tc1\tc2\nA\t1\t0\nB\t0\t2.5\n")
    x = matrix.read_table(spark, f"file://{tmp_path}/t.tsv")
    assert {(r.feature_id, r.cell_id, r.value) for r in x.assay("counts").collect()} == {("A", "c1", 1.0), ("B", "c2", 2.5)}
    x.save(f"file://{tmp_path}/saved")
    assert matrix.load(spark, f"file://{tmp_path}/saved").assay("counts").count() == 2


def test_whole_pipeline(spark):
    from quillon.plans import pipeline

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.poisson(4 * (np.arange(20)[None, :] // 7 == g) + 0.3, (25, 20)) for g in range(3)])
    rows = [(f"f{j}", i, float(x[i, j])) for i in range(75) for j in range(20) if x[i, j]]
    data = matrix.from_frames(spark.createDataFrame(rows, "feature_id string, cell_id long, value double"))
    data = pipeline.reduce(data, dims=5)
    out = pipeline.run(data, 2, 4, epochs=20, rounds=4)
    assert out.coords.count() == 75 and out.states["assignments"].count() == 75
    assert out.specificity.agg(F.min("significance")).first()[0] >= 0
    assert out.edges.count() == out.edges.join(out.edges.toDF("dst", "src", "w"), ["src", "dst"]).count()
    imputed = pipeline.impute(out.edges, data.assay("logcounts"), spark.createDataFrame([("f1",)], "feature_id string"))
    assert imputed.count() > 0


def test_stream_projects_new_cells(spark, tmp_path):
    from quillon.streaming.project import project_stream, write_batches

    source = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "cell_id long, vec array<double>")
    source.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"file://{tmp_path}/in")
    q = write_batches(project_stream(stream, np.eye(2)), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination(120)
    got = {(r.cell_id, r.arch): r.value for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got[1, 1] == pytest.approx(1) and got[2, 1] == pytest.approx(0.5)


def test_student_tails_and_phenotypes(spark):
    from quillon.operators import annotate

    assert annotate._student_tail(2.0, 10) == pytest.approx(0.036694, abs=1e-6)
    assert annotate._student_tail(-1.0, 3) == pytest.approx(1 - 0.195501, abs=1e-6)
    assert annotate._student_tail(40.0, 7.5) < 1e-8 and annotate._student_tail(0.0, 5) == pytest.approx(0.5)
    cells = spark.createDataFrame([(i, "k", i < 12, f"p{i % 2}{i < 12}") for i in range(24)], "cell_id long, cluster string, case boolean, individual string")
    rng = np.random.default_rng(9)
    assay = spark.createDataFrame([(f, i, float(rng.random() + (2 if f == "up" and i < 12 else 0))) for f in ("up", "flat") for i in range(24)], "feature_id string, cell_id long, value double")
    one = {r.feature_id: r for r in annotate.phenotype_features(assay, cells).collect()}
    assert one["up"].p < 1e-6 < 0.01 < one["flat"].p and one["up"].fdr <= 2 * one["up"].p + 1e-12
    many = {r.feature_id: r for r in annotate.phenotype_features_by_individual(assay, cells, 5).collect()}
    assert many["up"].p < 1e-3 and many["up"].log_fc > 4


def test_batches_far_apart_are_merged(spark):
    """Every near cell is of the same batch; mutual pairs are those of brute force across batches."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(60, 3))
    x = np.concatenate([a, rng.normal(size=(50, 3)) + 100])
    cells = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell_id long, vec array<double>")
    batches = spark.createDataFrame([(i, int(i >= 60)) for i in range(110)], "cell_id long, batch int")
    got = np.array([r.vec for r in decompose.mutual_neighbours_correction(cells, batches, 5).orderBy("cell_id").collect()])
    d = ((x[:60, None] - x[None, 60:]) ** 2).sum(2)
    near = np.argsort(np.argsort(d, axis=1), axis=1) < 5
    back = np.argsort(np.argsort(d, axis=0), axis=0) < 5
    i, j = np.nonzero(near & back)
    at, to = x[60 + j], x[i]
    e = ((x[60:, None] - at[None]) ** 2).sum(2)
    g = np.exp(-(e - e.min(axis=1, keepdims=True)) / (0.1 * at.var(axis=0).sum()))
    assert len(i) and np.allclose(got[60:], x[60:] + g @ (to - at) / g.sum(axis=1, keepdims=True), atol=1e-4)
    assert np.allclose(got[:60], a) and np.abs(got[60:].mean(axis=0)).max() < 5


@pytest.mark.parametrize("batched", [False, True])
def test_archetypes_of_many_cells_are_those_of_one_task(spark, batched):
    """Rare extreme cells carry archetypes and batches are corrected, whatever the number of cells."""
    rng = np.random.default_rng(8)
    corners = np.eye(4)[:3] * 0.7 + 0.075
    x = np.concatenate([rng.dirichlet(np.ones(3) * 20, 297) @ corners, corners])
    if batched:
        x[::2, 3] += 0.05

    def dense(rows):
        m = np.zeros((4, 4, 300))
        for r in rows.collect():
            m[r.k, r.arch, r.cell_id] = r.value
        return m

    cells = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell_id long, vec array<double>")
    batches = spark.createDataFrame([(i, i % 2) for i in range(300)], "cell_id long, batch int") if batched else None
    one, spread = (decompose.archetypes(cells, 2, 3, batches, 1, rounds=4, most_cells=m) for m in (1000, 50))
    (c, h), (c1, h1) = [[dense(m) for m in found] for found in (spread, one)]
    assert np.abs(h - h1).max() < 0.01
    unit = x / x.sum(1, keepdims=True)
    assert batched or np.abs(c @ unit - c1 @ unit).max() < 0.002  # the mixtures of one point are many
    assert batched or all(c[3, :, 297 + i].max() > 0.99 for i in range(3))


def test_least_cut_of_each_key(spark):
    """Sets of least conductance, key by key, are those of a walk over the ranks."""
    rng = np.random.default_rng(11)
    n = 40
    w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.2), 1)
    w[:20, 20:] *= 0.05
    w += w.T
    scores = {"near": np.where(np.arange(n) < 20, 2, 1) + rng.random(n) / 2, "any": rng.random(n)}
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "src long, dst long, weight double")
    rows = [(k, v, float(x)) for k, s in scores.items() for v, x in enumerate(s)]
    got = graph.least_cut(edges, spark.createDataFrame(rows, "key string, v long, score double")).collect()
    for k, s in scores.items():
        order = np.argsort(-np.round(s, 9), kind="stable")
        cost = {}
        for r in range(5, n - 6):
            top, rest = order[: r + 1], order[r + 1 :]
            cost[r] = w[np.ix_(top, rest)].sum() / min(w[top].sum(), w[rest].sum())
        best = min(cost, key=cost.get)
        assert {r.v for r in got if r.key == k} == set(order[: best + 1].tolist()), k
