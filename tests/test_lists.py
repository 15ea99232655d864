"""Neighbour lists of the adaptive graph, and what is computed from them, against plain arrays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import graph


def simplex_rows(spark, n=150, text=False, seed=1):
    x = np.random.default_rng(seed).dirichlet(np.ones(6) * 0.4, n)
    x[7], x[9, 0], x[20] = x[3], 0.0, x[3]
    x /= x.sum(1, keepdims=True)
    ids = [f"c{i}" if text else 3 * i for i in range(n)]
    return x, ids, spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x, strict=True)], f"cell_id {'string' if text else 'long'}, p array<double>")


def brute(x, ids, k):
    """Edges (src, dst): weight of the adaptive graph."""
    out = {}
    for r in range(len(x)):
        d = np.round(graph._jsd_block(np.repeat(x[r : r + 1], len(x), 0), x), 9)
        near = sorted((float(d[j]), ids[j]) for j in range(len(x)) if j != r)[:k]
        s = q = 0.0
        stop = k
        for rank, (b, _) in enumerate(near, 1):
            s, q = s + b, q + b * b
            inner = rank + s * s - rank * q
            if (0.0 if inner < 0 else (s + inner**0.5) / rank) < b:
                stop = rank - 1
                break
        out |= {(i, ids[r]): 1.0 - b for b, i in near[: max(0, stop - 1)]}
    return out


def edges_of(lists):
    return {(r.src, r.dst): r.weight for r in graph.unroll(lists).collect()}


@pytest.mark.parametrize("text", [False, True])
def test_lists_of_the_adaptive_graph_need_no_shuffle_of_pairs(spark, monkeypatch, text):
    """every pair of small blocks, ids of any kind, equal vectors and zeros."""
    monkeypatch.setattr(graph, "BLOCK", 32)
    x, ids, v = simplex_rows(spark, text=text)
    lists = graph.adaptive_lists(v, 40)
    assert edges_of(lists) == pytest.approx(brute(x, ids, 40), abs=1e-12)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "hashpartitioning" not in plan


def test_neighbours_of_a_block_are_sorted_some_rows_at_a_time():
    """far less memory than indices, copies and orders of all that was found; ties by id, rows without any."""
    import tracemalloc

    rng = np.random.default_rng(5)
    n, m = 256, 2048
    for k in (None, 40):
        scan = graph._Scan(np.arange(n), np.zeros((n, 1)))
        tracemalloc.start()
        for at in range(0, m, 256):
            i, j = np.nonzero(np.ones((n, 256), bool))
            i, j = i[i != 7], j[i != 7]
            scan.add(i, at + j[::-1].astype(np.int64), np.round(rng.random(len(i)), 2))
        found = [np.concatenate(c) for c in zip(*scan.found, strict=True)]
        size = sum(x.nbytes for x in found)
        order = np.lexsort((found[1], found[2], found[0]))
        want = [x[order] for x in found]
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        start, others, d = scan.sorted(k)
        most = tracemalloc.get_traced_memory()[1] - before
        tracemalloc.stop()
        assert start[7] == start[8] and start[-1] == len(others) == (n - 1) * (k or m)
        for r in range(n):
            of = want[0] == r
            assert others[start[r] : start[r + 1]].tolist() == want[1][of][:k].tolist()
            assert d[start[r] : start[r + 1]].tolist() == want[2][of][:k].tolist()
        assert most < 1.6 * size  # besides what was found; it was 2.4


def test_estimates_stay_within_their_error():
    """The cut on estimates loses no neighbour."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.dirichlet(np.ones(16) * a, 100) for a in (0.02, 0.3, 5.0)])
    f = graph._features(x)
    for r in range(0, 300, 7):
        d = graph._jsd_block(np.repeat(x[r : r + 1], 300, 0), x)
        assert np.abs(1 - f[r] @ f.T - d * d).max() < graph.JS_ERROR


def test_normalized_lists(spark):
    """weights by dst sum to 1 without a window over all edges."""
    _, _, v = simplex_rows(spark)
    lists = graph.adaptive_lists(v, 30)
    want = {(r.src, r.dst): r.weight for r in graph.normalize_in(graph.unroll(lists)).collect()}
    assert edges_of(graph.normalize_lists(lists)) == pytest.approx(want)


@pytest.mark.parametrize("method", ["AND", "OR"])
def test_mutual_lists_are_the_symmetrized_graph(spark, monkeypatch, method):
    """The graph in both directions from the reach of each vertex, not from a join of edges."""
    monkeypatch.setattr(graph, "BLOCK", 32)
    x, ids, v = simplex_rows(spark, seed=4)
    g = brute(x, ids, 25)
    both = {e: (w * g[e[1], e[0]]) ** 0.5 for e, w in g.items() if (e[1], e[0]) in g}
    some = {e: (g.get(e, 0.0) + g.get((e[1], e[0]), 0.0)) / 2 for e in [*g, *[(b, a) for a, b in g]]}
    lists = graph.mutual_lists(v, 25, method)
    assert edges_of(lists) == pytest.approx(both if method == "AND" else some, abs=1e-12)
    assert "hashpartitioning" not in lists._jdf.queryExecution().executedPlan().toString()


def linked_lists(spark, n=90, seed=6):
    """A graph in both directions as an array and as lists by dst."""
    rng = np.random.default_rng(seed)
    w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.15), 1)
    w += w.T
    rows = [(j, np.flatnonzero(w[:, j]).tolist(), w[w[:, j] > 0, j].tolist()) for j in range(n) if w[:, j].any()]
    return w, spark.createDataFrame(rows, "dst long, src array<long>, weight array<double>")


def keyed(spark, x, key="key", v="v", value="value"):
    return spark.createDataFrame([(k, i, float(x[i, k])) for i in range(len(x)) for k in range(x.shape[1])], f"{key} int, {v} long, {value} double")


def test_geary_over_lists(spark, monkeypatch):
    """edges are not multiplied by keys."""
    monkeypatch.setattr(graph, "BLOCK", 16)
    w, lists = linked_lists(spark)
    x = np.random.default_rng(1).normal(size=(90, 3))
    for r in graph.geary(lists, keyed(spark, x)).collect():
        y = x[:, r.key]
        q = (w * (y[:, None] - y[None]) ** 2).sum() / 2
        assert r.c == pytest.approx(89 * q / (2 * w.sum() * 90 * y.var()))


def test_pagerank_over_lists(spark, monkeypatch):
    """keys that few vertices have, over lists as over edges."""
    monkeypatch.setattr(graph, "BLOCK", 16)
    w, lists = linked_lists(spark)
    x = keyed(spark, np.random.default_rng(2).random((90, 2))).where("v % 3 = key")
    for f in (lambda e: graph.pagerank_step(e, x, x, x.select("v")), lambda e: graph.pagerank(e, x, x.select("v"))):
        one, two = ({(r.key, r.v): r.value for r in f(e).collect()} for e in (lists, graph.outgoing(lists)))
        assert one == pytest.approx(two)
    p = w / w.sum(0).clip(1e-300)
    x0 = np.array([[r.value if r else 0.0 for r in [next((s for s in x.collect() if s.key == 0 and s.v == i), None)]] for i in range(90)])[:, 0]
    left = (x0 * np.where(w.sum(0) > 0, 0.15, 1.0)).sum()
    got = {r.v: r.value for r in graph.pagerank_step(lists, x, x, x.select("v")).where("key = 0").collect()}
    assert got == pytest.approx({i: v for i, v in enumerate(0.85 * p @ x0 + x0 * left) if v})


def test_moran_over_lists(spark, monkeypatch):
    """F20."""
    monkeypatch.setattr(graph, "BLOCK", 16)
    w, lists = linked_lists(spark)
    x = np.random.default_rng(3).normal(size=(90, 3))
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    got = graph.moran_backbone(lists, keyed(spark, x, "arch", "cell_id").select("cell_id", "arch", "value"), 90).collect()
    want = z.T @ (w.T @ z) / 90
    assert len(got) == 9 and all(r.value == pytest.approx(want[r.a, r.b]) for r in got)


@pytest.mark.parametrize("text", [False, True])
def test_blocks_of_shares_are_the_normalized_lists(spark, monkeypatch, text):
    """some blocks, vertices without edges, ids of any kind."""
    monkeypatch.setattr(graph, "BLOCK", 32)
    monkeypatch.setattr(graph, "EDGES", 60)
    _, _, v = simplex_rows(spark, text=text)
    blocks = graph.adaptive_shares(v, 40).collect()
    got, n = {}, 0
    for b in blocks:
        assert len(b.near) <= 60 or len(b.ids) == 1
        assert sum(b.sizes) == len(b.near) == len(b.weight) and min(b.sizes) > 0
        at = np.cumsum([0, *b.sizes]).tolist()
        n += len(b.near)
        got |= {(s, i): w for i, lo, hi in zip(b.ids, at, at[1:], strict=False) for s, w in zip(b.near[lo:hi], b.weight[lo:hi], strict=True)}
    assert len(blocks) > 5 and n == len(got)
    assert got == pytest.approx(edges_of(graph.normalize_lists(graph.adaptive_lists(v, 40))), abs=1e-12)


def test_moran_stores_no_edges(spark, monkeypatch):
    """the graph is read once, where it is made; as from stored lists."""
    from conftest import SF

    from quillon.plans import queries

    stored = []
    for m in (graph, queries):
        monkeypatch.setattr(m, "materialize", lambda df, label, *more, real=m.materialize: (stored.append((label, df.columns)), real(df, label, *more))[1])
    got = {(r.a, r.b): r.value for r in queries.QUERIES["moran_backbone"](spark, SF).collect()}
    assert stored and not [x for x in stored if "weight" in x[1]]
    h = queries.dims(spark, SF).select("cell_id", F.col("dim").alias("arch"), "value")
    lists = graph.normalize_lists(queries.directed(spark, SF))
    want = {(r.a, r.b): r.value for r in graph.moran_backbone(lists, h, h.select("cell_id").distinct().count()).collect()}
    assert len(got) == 4096 and got == pytest.approx(want, abs=2e-6)


def test_sweep_over_lists(spark, monkeypatch):
    """every key's cuts, over lists as over edges."""
    monkeypatch.setattr(graph, "BLOCK", 16)
    _, lists = linked_lists(spark)
    scores = keyed(spark, np.random.default_rng(4).random((90, 3)), value="score")
    one, two = ({(r.key, r.v, r["rank"]): r.conductance for r in graph.sweep_cut(e, scores).collect()} for e in (lists, graph.outgoing(lists)))
    assert len(one) == 270 and one == pytest.approx(two)


def edge_shuffles(df):
    """Windows of a plan, which sort all of their rows."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Window")


def test_shares_of_neighbours_without_a_window_over_edges(spark):
    """only sums of vertices travel."""
    from quillon.operators import labels

    _, lists = linked_lists(spark)
    p = graph.double_stochastic(graph.outgoing(lists), False)
    assert edge_shuffles(p) == 0
    assert p.groupBy("src").agg(F.sum("weight").alias("s")).where("abs(s - 1) > 1e-9").isEmpty()
    known = spark.createDataFrame([(i, i % 2) for i in range(90)], "v long, label int")
    assert "strategy=broadcast" in labels.local_enrichment(p, known)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("run", [lambda e, v: graph.k_core(e), lambda e, v: graph.components(e, v), lambda e, v: graph.communities(e, v), lambda e, v: graph.categorical_phi(e, v.withColumn("label", F.col("v") % 2))])
def test_edges_stay_where_they_are(spark, monkeypatch, run):
    """vertices are sent to edges in every round, never edges to vertices."""
    sent = []
    monkeypatch.setattr(F, "broadcast", lambda df, real=F.broadcast: sent.append(df) or real(df))
    _, lists = linked_lists(spark)
    assert run(graph.outgoing(lists), spark.range(90).withColumnRenamed("id", "v")).count() and sent


def test_mutual_pairs_stay_off_the_driver(spark, monkeypatch):
    """shifts go past blocks of cells; the driver collects no vectors."""
    from pyspark.sql.classic.dataframe import DataFrame

    from quillon.operators import decompose

    monkeypatch.setattr(graph, "BLOCK", 16)
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("collected"))
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(50, 3)) + 3])
    cells = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell_id long, vec array<double>")
    batches = spark.createDataFrame([(i, int(i >= 60)) for i in range(110)], "cell_id long, batch int")
    got = np.array([r.vec for r in decompose.mutual_neighbours_correction(cells, batches, 5).orderBy("cell_id").collect()])
    d = np.round(np.sqrt(((x[:60, None] - x[None, 60:]) ** 2).sum(2)), 9)
    near, back = np.argsort(np.argsort(d, axis=1), axis=1) < 5, np.argsort(np.argsort(d, axis=0), axis=0) < 5
    i, j = np.nonzero(near & back)
    at, to = x[60 + j], x[i]
    e = ((x[60:, None] - at[None]) ** 2).sum(2)
    g = np.exp(-(e - e.min(axis=1, keepdims=True)) / (0.1 * at.var(axis=0).sum()))
    assert np.allclose(got[60:], x[60:] + g @ (to - at) / g.sum(axis=1, keepdims=True)) and np.allclose(got[:60], x[:60])




@pytest.mark.parametrize("text", [False, True])
def test_correlations_of_many_columns_by_blocks(spark, monkeypatch, text):
    """all pairs of columns, also those without a shared row and constant ones, without a join of pairs."""
    from quillon.operators import linalg

    monkeypatch.setattr(linalg, "FEW_COLUMNS", 10)
    rng = np.random.default_rng(3)
    m = np.where(rng.random((40, 60)) < 0.1, rng.integers(1, 9, (40, 60)), 0).astype(float)
    m[0] = 1.0
    rows = [(f"r{i}", f"c{j:02}" if text else j * 7, float(m[i, j])) for i in range(40) for j in range(60) if m[i, j]]
    got = linalg.correlation(spark.createDataFrame(rows, f"r string, c {'string' if text else 'long'}, value double"), "r", "c", 41)
    want = np.corrcoef(np.vstack([m, np.zeros(60)]).T)
    values = {(int(r.a[1:]), int(r.b[1:])) if text else (r.a // 7, r.b // 7): r.value for r in got.collect()}
    assert len(values) == 60 * 59 // 2 and all(v == pytest.approx(want[k]) for k, v in values.items())
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def shuffled(monkeypatch):
    """Tables written on the way, by label, and what is sent to the driver to be broadcast."""
    seen = []
    monkeypatch.setattr(F, "broadcast", lambda df: pytest.fail("broadcast"))
    monkeypatch.setattr(graph, "materialize", lambda df, label, *a, real=graph.materialize: seen.append((label, df)) or real(df, label, *a))
    return seen


def as_text(lists):
    return lists.select(F.concat(F.lit("v"), "dst").alias("dst"), F.transform("src", lambda x: F.concat(F.lit("v"), x)).alias("src"), "weight")


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize(
    "run", [lambda e, v: graph.k_core(e), lambda e, v: graph.components(graph.heavier(e, 0.9) if graph._as_lists(e) else e.where("weight > 0.9"), v), lambda e, v: graph.communities(e, v)]
)
def test_rounds_over_lists(spark, monkeypatch, run, text):
    """the same as over edges, while no edge is written again, shuffled or met by a broadcast."""
    for name in ("BLOCK", "EDGES", "WIDE"):
        monkeypatch.setattr(graph, name, 64)
    _, lists = linked_lists(spark)
    v = spark.range(95).withColumnRenamed("id", "v")
    if text:
        lists, v = as_text(lists), v.select(F.concat(F.lit("v"), "v").alias("v"))
    want = sorted(run(graph.outgoing(lists), v).collect())
    seen = shuffled(monkeypatch)
    assert sorted(run(lists, v).collect()) == want
    assert seen and not [label for label, _ in seen if label.endswith("edges")]
    assert all(df.count() <= 95 for _, df in seen)


def test_loops_of_lists(spark):
    """loops count for nothing, as over edges."""
    lists = spark.createDataFrame([(1, [1, 2], [1.0, 0.5]), (2, [1, 3], [0.5, 0.25]), (3, [2], [0.25]), (4, [4], [1.0])], "dst long, src array<long>, weight array<double>")
    v = spark.createDataFrame([(i,) for i in range(1, 6)], "v long")
    for f in (graph.k_core, lambda e: graph.communities(e, v), lambda e: graph.components(e, v)):
        assert sorted(f(lists).collect()) == sorted(f(graph.outgoing(lists)).collect())


def test_whole_procedures_over_lists(spark, monkeypatch):
    """The same as over edges, and the edges are not written again."""
    from quillon.operators import labels

    monkeypatch.setattr(graph, "BLOCK", 16)
    _, lists = linked_lists(spark)
    known = spark.createDataFrame([(i, f"l{i % 3}" if i % 7 else None) for i in range(92)], "v long, label string")
    full = known.select("v", (F.col("v") % 3).alias("label"))
    for f in (lambda e: graph.connectivity(e, full.select("v"), full), lambda e: labels.highlight(e, known), lambda e: graph.categorical_phi(e, full)):
        one, two = (sorted([tuple(r) for r in f(e).collect()], key=str) for e in (lists, graph.outgoing(lists)))
        assert len(one) == len(two) and all(x == (pytest.approx(y) if isinstance(y, float) else y) for a, b in zip(one, two, strict=True) for x, y in zip(a, b, strict=True))
    seen = []
    monkeypatch.setattr(graph, "materialize", lambda df, label, *a, real=graph.materialize: seen.append(label) or real(df, label, *a))
    graph.connectivity(lists, full.select("v"), full).count()
    assert not {"lists", "core-edges"} & set(seen)


def test_layout_sends_only_edges_that_move(spark, monkeypatch):
    """weights by list as by edge; edges that are never due stay where they are, and places are the same."""
    from quillon.operators import layout

    _, lists = linked_lists(spark)
    one, two = ({(r.src, r.dst): r.weight for r in layout.smooth_weights(e).collect()} for e in (lists, graph.outgoing(lists).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    assert one == pytest.approx(two)
    assert "Join" not in layout.smooth_weights(lists)._jdf.queryExecution().executedPlan().toString()
    every = np.array(list(one.values()))
    real = layout.optimize
    src, dst = np.array(list(one)).T
    start = np.random.default_rng(5).normal(size=(90, 2))
    keep = 1.0 / np.maximum(every, 1e-12) <= 3
    assert 0 < keep.sum() < len(keep)
    assert (real(src, dst, every, start, 1.5, 0.9, 3) == real(src[keep], dst[keep], every[keep], start, 1.5, 0.9, 3)).all()
    cells = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(np.random.default_rng(5).normal(size=(90, 3)))], "cell_id long, vec array<double>")
    a, b = (sorted(layout.layout(e, cells, epochs=3).collect()) for e in (lists, graph.outgoing(lists)))
    assert np.allclose(np.array(a), np.array(b))


@pytest.mark.parametrize("text", [False, True])
def test_doubly_stochastic_rows_meet_by_blocks(spark, monkeypatch, text):
    """neither paths of two edges nor pairs of rows are shuffled; weights of zero count as edges, also where
    all of a vertex are zero."""
    monkeypatch.setattr(graph, "EDGES", 64)
    monkeypatch.setattr(graph, "BLOCK", 16)
    n, rng = 70, np.random.default_rng(4)
    a = np.triu(np.where(rng.random((n, n)) < 0.12, rng.random((n, n)), 0.0), 1)
    a += a.T
    there = a > 0
    a[3], a[:, 3] = 0.0, 0.0  # its edges stay
    i, j = map(int, np.argwhere(there & (a > 0))[0])
    a[i, j] = a[j, i] = 0.0
    name = (lambda x: f"c{x:02d}") if text else (lambda x: 5 * x)
    kind = "string" if text else "long"
    lists = spark.createDataFrame([(name(x), [name(int(y)) for y in np.flatnonzero(there[x])], a[x][there[x]].tolist()) for x in range(n) if there[x].any()], f"dst {kind}, src array<{kind}>, weight array<double>")
    p = a / np.where(a.sum(1) > 0, a.sum(1), 1.0)[:, None]
    w = p / np.sqrt(p.sum(axis=0) + 1e-16)
    value, met = w @ w.T, there.astype(int) @ there.T > 0
    expected = {(name(x), name(y)): value[x, y] for x, y in np.argwhere(met).tolist()}
    for edges in (lists, graph.unroll(lists)):
        found = graph.double_stochastic(edges)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "hashpartitioning" not in plan
        got = found.collect()
        assert len(got) == len(expected)
        assert {(r.src, r.dst): r.weight for r in got} == pytest.approx(expected, abs=1e-12)


def test_wide_values_go_to_python_in_small_batches(spark, monkeypatch):
    """a batch has a few blocks of values at most, and the session keeps its setting."""
    monkeypatch.setattr(graph, "BLOCK", 16)
    monkeypatch.setattr(graph, "SMALL", "4k")
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label, *more: (seen.append((label, spark.conf.get(name))), real(df, label, *more))[1])
    before = spark.conf.get(name)
    _, lists = linked_lists(spark)
    scores = keyed(spark, np.random.default_rng(4).random((90, 3)), value="score")
    assert graph.sweep_cut(lists, scores).count() == 270
    assert ("sums", "4k") in seen and spark.conf.get(name) == before


@pytest.mark.parametrize("text", [False, True])
def test_cores_of_long_chains_need_no_rounds(spark, monkeypatch, text):
    """r03 F2: a chain of 300 vertices, of which each waits for the one before, and a ring with chords; the tables
    written on the way do not grow in number with the chain, and rounds (above PEELED) give the same."""
    for name in ("BLOCK", "EDGES", "WIDE", "PEEL"):
        monkeypatch.setattr(graph, name, 64)
    near = {x: {x - 1, x + 1} & set(range(300)) for x in range(300)}
    near |= {1000 + x: {1000 + (x + j) % 40 for j in (-2, -1, 1, 2)} for x in range(40)}
    near |= {2000 + x: {2000 + x + j for j in (-2, -1, 1, 2)} & set(range(2000, 2030)) for x in range(30)}
    lists = spark.createDataFrame([(x, sorted(n), [1.0] * len(n)) for x, n in near.items()], "dst long, src array<long>, weight array<double>")
    name = lambda x: f"v{x}" if text else x
    seen = shuffled(monkeypatch)
    got = {r.v: r.core for r in graph.k_core(as_text(lists) if text else lists).collect()}
    assert got == {name(x): 1 if x < 1000 else 4 if x < 2000 else 2 for x in near}
    assert len(seen) <= 5
    monkeypatch.setattr(graph, "PEELED", 10)
    assert sorted(graph.k_core(lists.where("dst between 1000 and 1999")).collect()) == [(1000 + x, 4) for x in range(40)]


def test_few_values_are_gathered_by_edge(spark, monkeypatch):
    """r03 F3: sums of one or two columns, with nulls and vertices without a value, take no block of 64 ids at a time
    and are those of matrix products."""
    monkeypatch.setattr(graph, "BLOCK", 16)
    _, lists = linked_lists(spark)
    named = lists.select(F.col("dst").alias("v"), F.col("src").alias("near"), "weight")
    values = spark.createDataFrame([(i, [float(i * i), None if i % 5 == 0 else 1.0 / (1 + i)]) for i in range(80)], "v long, x array<double>")
    tables = []
    monkeypatch.setattr(graph, "materialize", lambda df, label, *a, real=graph.materialize: tables.append((label, real(df, label, *a))) or tables[-1][1])
    got = {r.v: r.x for r in graph._along(named, values).collect()}
    assert [t.count() for label, t in tables if label == "values"] == [1]
    monkeypatch.setattr(graph, "FEW", 0)
    want = {r.v: r.x for r in graph._along(named, values).collect()}
    assert got.keys() == want.keys() and len(got) == 90
    assert all(a == (b if b is None else pytest.approx(b)) for v in got for a, b in zip(got[v], want[v], strict=True))


def test_rows_that_meet_are_rounded_where_they_are_made(spark, monkeypatch):
    """r03 F1: rounded in blocks as Spark rounds, of which each pair is computed once."""
    from quillon.functions.scalars import rounded

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.random(2000) * 10.0 ** rng.integers(-12, 9, 2000), (np.arange(500) + 0.5) * 1e-9, [0.0, -0.0, 1e-10, -2.5e-9, 1e15, 1e300, 5e-10]])
    want = [r.y for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", rounded("x", 9).alias("y")).orderBy("i").collect()]
    assert graph.half_up(x, 9).tolist() == want
    monkeypatch.setattr(graph, "EDGES", 64)
    monkeypatch.setattr(graph, "BLOCK", 16)
    _, lists = linked_lists(spark)
    plain = {(r.src, r.dst): r.weight for r in graph.double_stochastic(lists).select("src", "dst", rounded("weight", 9).alias("weight")).collect()}
    found = graph.double_stochastic(lists, digits=9).collect()
    assert len(found) == len(plain) and {(r.src, r.dst): r.weight for r in found} == plain
    assert all(plain[j, i] == w for (i, j), w in plain.items())
