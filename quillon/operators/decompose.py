"""Reduction and archetypal analysis.

Cells are rows with short array vectors. Steps that touch cells one by one run in mapInPandas with the
small matrices in the task; sums over cells are aggregated by task before they meet. The archetype
problem of one depth k is solved in one task where there are at most ``most_cells`` cells; more are fitted
by passes over all of them, which bring only sums and the few cells that carry an archetype to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import ratio
from quillon.operators import graph, linalg
from quillon.tables import materialize

ROUNDS = 50
MOST_CELLS = 20_000
#: Cells that a pass adds for an archetype; the gap at which a mixture of cells counts as the nearest.
ADDED, GAP = 8, 1e-9


def simplex_projection(v: np.ndarray) -> np.ndarray:
    """Rows of v moved to the nearest points of the simplex."""
    u = -np.sort(-v, axis=1)
    c = (np.cumsum(u, axis=1) - 1) / np.arange(1, v.shape[1] + 1)
    k = (u > c).sum(axis=1) - 1
    return np.maximum(v - c[np.arange(len(v)), k][:, None], 0)


def simplex_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Rows x on the simplex that minimize |x a - b| for each row of b; a is archetypes x dims.
    Accelerated projected gradient with restarts, polished on the support that it finds."""
    g, t = a @ a.T, b @ a.T
    step = 1.0 / max(np.linalg.eigvalsh(g)[-1], 1e-12)
    x = np.full((len(b), len(a)), 1.0 / len(a))
    y, m = x.copy(), 1.0
    for _ in range(rounds):
        new = simplex_projection(y - step * (y @ g - t))
        m2 = (1 + np.sqrt(1 + 4 * m * m)) / 2
        if ((y - new) * (new - x)).sum() > 0:
            m2, y = 1.0, new
        else:
            y = new + (m - 1) / m2 * (new - x)
        done = np.abs(new - x).max() < 1e-10
        x, m = new, m2
        if done:
            break
    x[x < 1e-9] = 0
    return x / x.sum(axis=1, keepdims=True)


def simplex_regression(cells: DataFrame, archetypes: np.ndarray) -> DataFrame:
    """(cell_id, arch, value): each cell of ``cells(cell_id, vec)`` as a convex mixture of archetypes (rows),
    non-zero entries only; one independent problem a cell."""
    kind = dict(cells.dtypes)["cell_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = simplex_least_squares(archetypes, np.stack(b["vec"].to_numpy()).astype(float))
                i, j = np.nonzero(x)
                yield pd.DataFrame({"cell_id": b["cell_id"].to_numpy()[i], "arch": (j + 1).astype(np.int32), "value": x[i, j]})

    return cells.select("cell_id", "vec").mapInPandas(run, f"cell_id {kind}, arch int, value double")


def _gram(cells: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum of outer products, sum, and number of the vectors, added up by task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = s = None
        n = 0
        for b in batches:
            if len(b):
                x = np.stack(b["vec"].to_numpy()).astype(float)
                g, s, n = (x.T @ x, x.sum(0), len(x)) if g is None else (g + x.T @ x, s + x.sum(0), n + len(x))
        if g is not None:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    parts = cells.select("vec").mapInPandas(run, "n long, s array<double>, g array<double>")
    sums = parts.select("n", F.posexplode(F.concat("s", "g")).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("at").collect()
    x = np.array([r["x"] for r in sums])
    dims = int((np.sqrt(1 + 4 * len(x)) - 1) / 2)
    return x[dims:].reshape(dims, dims), x[:dims], int(sums[0]["n"])


def principal_axes(cells: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors dims x k, singular values) of cells as rows, from the Gram matrix; each
    vector's largest loading is positive."""
    g, _, _ = _gram(cells)
    w, v = np.linalg.eigh(g)
    order = np.argsort(-w)[:k]
    v = v[:, order]
    v *= np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return v, np.sqrt(np.clip(w[order], 0, None))


def project(cells: DataFrame, axes: np.ndarray) -> DataFrame:
    """(cell_id, vec): vectors times ``axes``."""
    kind = dict(cells.dtypes)["cell_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"cell_id": b["cell_id"], "vec": list(np.stack(b["vec"].to_numpy()).astype(float) @ axes)})

    return cells.select("cell_id", "vec").mapInPandas(run, f"cell_id {kind}, vec array<double>")


def svd_reduce(cells: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    axes, s = principal_axes(cells, k)
    return project(cells, axes), axes, s


def randomized_axes(assay: DataFrame, k: int, iterations: int = 5, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(loadings(feature_id, vec), singular values) of a sparse features x cells matrix by block power
    iteration: each multiplication is a join and an aggregate, and only k + 5 square matrices are
    solved on the driver."""
    width = k + 5
    q = assay.select("feature_id").distinct().select("feature_id", F.array(*[F.randn(seed + i) for i in range(width)]).alias("vec"))

    def times(m: DataFrame, q: DataFrame, inner: str, outer: str) -> DataFrame:
        j = m.join(q, inner)
        sums = [F.sum(F.col("value") * F.col("vec")[i]) for i in range(width)]
        return j.groupBy(outer).agg(F.array(*sums).alias("vec"))

    def orthonormal(x: DataFrame, key: str) -> tuple[DataFrame, np.ndarray]:
        x = materialize(x, "power")
        g, _, _ = _gram(x)
        w, v = np.linalg.eigh(g)
        good = w > 1e-12 * w[-1]
        inv = v[:, good] / np.sqrt(w[good])
        full = np.zeros((width, width))
        full[:, : inv.shape[1]] = inv[:, ::-1]
        return project(x.withColumnRenamed(key, "cell_id"), full).withColumnRenamed("cell_id", key), np.sqrt(np.clip(w[::-1], 0, None))

    s = np.zeros(width)
    for _ in range(iterations):
        u, _ = orthonormal(times(assay, q, "feature_id", "cell_id"), "cell_id")
        q, s = orthonormal(times(assay, u, "cell_id", "feature_id"), "feature_id")
    return materialize(q.select("feature_id", F.slice("vec", 1, k).alias("vec")), "loadings"), s[:k]


def reduce_expression(assay: DataFrame, features: int, cells: int, k: int = 50, iterations: int = 5) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(reduced(cell_id, vec), loadings(feature_id, vec), explained variance of the kept components).

    Columns are scaled to length 1, the direction of the mean profile is removed, and each cell is
    centred: A + v b1' + 1 b2' with v the mean direction, b1 = -A' v and b2 = -(mean(v) b1 + column
    means). The correction has rank two, so the matrix stays sparse: it is applied to the products with
    two extra scalars for each cell."""
    a = materialize(linalg.l2_normalize(assay, "cell_id"), "unit")
    mu = a.groupBy("feature_id").agg((F.sum("value") / cells).alias("mu"))
    norm = F.sqrt(F.sum(F.col("mu") * F.col("mu")))
    v = materialize(mu.crossJoin(F.broadcast(mu.agg(norm.alias("norm")))).select("feature_id", ratio("mu", "norm").alias("v")), "mean-direction")
    mean_v = (v.agg(F.sum("v")).first()[0] or 0.0) / features
    per = a.join(v, "feature_id").groupBy("cell_id").agg((-F.sum(F.col("value") * F.col("v"))).alias("b1"), (F.sum("value") / features).alias("c"))
    per = materialize(per.select("cell_id", "b1", (-(mean_v * F.col("b1") + F.col("c"))).alias("b2")), "cell-terms")
    loadings, s = randomized_axes(a, k + 2, iterations)
    # Within the span of the sparse matrix and the two corrections the problem is small.
    basis = loadings.join(v, "feature_id", "left").select("feature_id", F.concat("vec", F.array(F.coalesce("v", F.lit(0.0)), F.lit(1.0))).alias("vec"))
    g, _, _ = _gram(basis)
    width = k + 4
    w, e = np.linalg.eigh(g)
    white = e[:, w > 1e-10] / np.sqrt(w[w > 1e-10])
    dots = a.join(basis, "feature_id").groupBy("cell_id").agg(F.array(*[F.sum(F.col("value") * F.col("vec")[i]) for i in range(width)]).alias("p"))
    both = dots.join(per, "cell_id").select("cell_id", F.concat("p", F.array("b1", "b2")).alias("vec"))
    lift = np.zeros((width + 2, white.shape[1]))
    lift[:width] = white
    lift[width], lift[width + 1] = g[:, width - 2] @ white, g[:, width - 1] @ white
    moved = materialize(project(both, lift), "reduced")
    axes, sv = principal_axes(moved, k + 2)
    kept = project(moved, axes[:, :k])
    back = project(basis.withColumnRenamed("feature_id", "cell_id"), white @ axes[:, :k]).withColumnRenamed("cell_id", "feature_id")
    var = sv**2 / max(features - 1, 1)
    return kept, back, np.cumsum(var[:k]) / max(var.sum(), 1e-300)


def leverage_top(cells: DataFrame, k: int, dims: int = 10) -> DataFrame:
    """(cell_id, score, rank): the k cells with the highest leverage, the squares of their left singular
    vectors' entries."""
    axes, s = principal_axes(cells, dims)
    u = project(cells, axes / np.where(s > 1e-12, s, np.inf))
    score = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    top = u.select("cell_id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "cell_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "cell_id")))


def successive_projection(cells: DataFrame, k: int) -> DataFrame:
    """(step, cell_id, norm): k cells, each the one with the largest residual after projecting out those
    before it; near ties (one in a million) go to the largest original norm, then the smallest id."""
    spark = cells.sparkSession
    base = materialize(cells.select("cell_id", F.col("vec").cast("array<double>").alias("vec")), "projection")
    basis: list[np.ndarray] = []
    picked = []
    for step in range(1, k + 1):
        left = list(basis)

        def residual(batches: Iterator[pd.DataFrame], left=left) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = np.stack(b["vec"].to_numpy())
                    r = x.copy()
                    for q in left:
                        r -= (r @ q)[:, None] * q
                    yield pd.DataFrame({"cell_id": b["cell_id"], "norm": (r * r).sum(1), "first": (x * x).sum(1), "vec": list(r)})

        kind = dict(base.dtypes)["cell_id"]
        r = base.mapInPandas(residual, f"cell_id {kind}, norm double, first double, vec array<double>")
        top = r.agg(F.max("norm")).first()[0]
        if top is None or top <= 1e-18:
            break
        row = r.where(F.col("norm") >= top * (1 - 1e-6)).orderBy(F.desc("first"), "cell_id").first()
        v = np.array(row["vec"])
        basis.append(v / np.linalg.norm(v))
        picked.append((step, row["cell_id"], float(row["norm"])))
    return spark.createDataFrame(picked, f"step int, cell_id {dict(base.dtypes)['cell_id']}, norm double")


def _spa(x: np.ndarray, k: int) -> list[int]:
    r, first = x.copy(), (x * x).sum(1)
    out: list[int] = []
    for _ in range(k):
        norm = (r * r).sum(1)
        if norm.max() <= 1e-18:
            break
        near = np.flatnonzero(norm >= norm.max() * (1 - 1e-6))
        out.append(int(near[first[near].argmax()]))
        q = r[out[-1]] / np.sqrt(norm[out[-1]])
        r -= (r @ q)[:, None] * q
    return out


def archetypal_analysis(x: np.ndarray, w: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(C archetypes x cells, H cells x archetypes, archetypes) for cells as rows of x: H by simplex least
    squares, then each archetype as the mixture of cells nearest to its target, in turn. A row of H that
    is empty starts again at the worst-fitted cell."""
    k = len(w)
    c = np.zeros((k, len(x)))
    for _ in range(rounds):
        h = simplex_least_squares(w, x, 100)
        res = x - h @ w
        for j in range(k):
            q = float(h[:, j] @ h[:, j])
            if q < 1e-7:
                worst = int((res * res).sum(1).argmax())
                c[j] = 0
                c[j, worst] = 1
                w[j] = x[worst]
                continue
            target = w[j] + h[:, j] @ res / q
            # Frank-Wolfe with away steps over cells: few cells carry an archetype.
            mix = c[j].copy() if c[j].sum() > 0.5 else np.eye(1, len(x), int(((x - target) ** 2).sum(1).argmin()))[0]
            point = mix @ x
            for _ in range(40):
                grad = x @ (point - target)
                on = np.flatnonzero(mix)
                toward, away = int(grad.argmin()), int(on[grad[on].argmax()])
                gap = grad[away] - grad[toward]
                if gap < 1e-10:
                    break
                d = x[toward] - x[away]
                size = min(mix[away], gap / max(float(d @ d), 1e-300))
                mix[toward] += size
                mix[away] -= size
                point = point + size * d
            res += np.outer(h[:, j], w[j] - point)
            c[j], w[j] = mix, point
    return c, simplex_least_squares(w, x), w


def _ridge_shift(x: np.ndarray, h: np.ndarray, onehot: np.ndarray, lam: float) -> np.ndarray:
    """The batch terms of a ridge regression of cells on [1, batch], weighted by each archetype."""
    phi = np.column_stack([np.ones(len(x)), onehot])
    total = np.zeros_like(x)
    for j in range(h.shape[1]):
        p = phi * h[:, j : j + 1]
        beta = np.linalg.solve(p.T @ phi + lam * np.eye(phi.shape[1]), p.T @ x)
        beta[0] = 0
        total += p @ beta
    return total


def archetypes(cells: DataFrame, k_min: int = 2, k_max: int = 20, batches: DataFrame | None = None, correction_rounds: int = 3, lam: float = 1.0, rounds: int = ROUNDS, most_cells: int = MOST_CELLS) -> tuple[DataFrame, DataFrame]:
    """(C, H), both (k, arch, cell_id, value), for every depth k; one task for each depth.

    Vectors are scaled to absolute sum 1. Start points come from successive projection. With ``batches``
    (cell_id, batch) every round is followed by a batch correction. Beyond ``most_cells`` cells the same
    is done by passes over all cells.
    """
    kind = dict(cells.dtypes)["cell_id"]
    unit = cells.select("cell_id", F.col("vec").cast("array<double>").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x))
    unit = unit.withColumn("t", total).select("cell_id", F.transform("v", lambda x: x / F.when(F.col("t") > 0, F.col("t"))).alias("vec"))
    unit = unit if batches is None else unit.join(batches.select("cell_id", "batch"), "cell_id")
    n = unit.count()
    if n > most_cells:
        return _spread_archetypes(materialize(unit, "archetype-cells"), k_min, k_max, correction_rounds if batches is not None else 0, lam, rounds)
    depth = F.explode(F.sequence(F.lit(k_min), F.lit(max(k_min, min(k_max, n)))))
    schema = f"k int, arch int, cell_id {kind}, value double, side string"

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cell_id")
        k, ids, x = int(part["k"].iloc[0]), part["cell_id"].to_numpy(), np.stack(part["vec"].to_numpy())
        start = _spa(x, k)
        c, h, w = archetypal_analysis(x, x[start].copy(), rounds)
        if "batch" in part.columns:
            levels = sorted(set(part["batch"]))
            onehot = (part["batch"].to_numpy()[:, None] == np.array(levels)[None, :]).astype(float)
            for _ in range(correction_rounds):
                fixed = x - _ridge_shift(x, h, onehot, lam)
                fixed /= np.maximum(np.abs(fixed).sum(1, keepdims=True), 1e-300)
                c, h, w = archetypal_analysis(fixed, c @ fixed, rounds)
        out = []
        for side, m in (("C", c), ("H", h.T)):
            i, j = np.nonzero(m > 1e-9)
            out.append(pd.DataFrame({"k": k, "arch": i + 1, "cell_id": ids[j], "value": m[i, j], "side": side}))
        return pd.concat(out)

    both = materialize(unit.withColumn("k", depth).groupBy("k").applyInPandas(solve, schema), "archetypes")
    c, h = (both.where(F.col("side") == s).drop("side") for s in "CH")
    return c, h


def _depths(b: pd.DataFrame, depths: list[int]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each depth: all of them, unless rows carry their depth ``k``."""
    for k in depths:
        g = b[b["k"] == k] if "k" in b.columns else b
        if len(g):
            yield k, g


def _added_up(parts: DataFrame, keys: list[str]) -> list:
    """Arrays ``s`` of tasks added up by ``keys``, element by element."""

    def add(p: pd.DataFrame) -> pd.DataFrame:
        return p[keys].iloc[:1].assign(s=[np.sum(np.stack(p["s"].to_numpy()), axis=0).tolist()])

    return parts.groupBy(*keys).applyInPandas(add, parts.select(*keys, "s").schema).collect()


def _mixture_sums(cells: DataFrame, w: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, tuple]]:
    """For each depth: H'H, H'X, and the (cell_id, vec) that the archetypes ``w`` fit worst."""
    kind = dict(cells.dtypes)["cell_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        worst: dict[int, tuple] = {}
        for b in batches:
            for k, g in _depths(b, list(w)):
                x = np.stack(g["vec"].to_numpy()).astype(float)
                h = simplex_least_squares(w[k], x, 100)
                miss = ((x - h @ w[k]) ** 2).sum(1)
                at = int(miss.argmax())
                sums[k] = sums.get(k, 0) + np.concatenate([(h.T @ h).ravel(), (h.T @ x).ravel()])
                if k not in worst or miss[at] > worst[k][0]:
                    worst[k] = (float(miss[at]), g["cell_id"].iloc[at], x[at].tolist())
        for k in sums:
            yield pd.DataFrame({"k": [k], "s": [sums[k].tolist()], "miss": [worst[k][0]], "cell_id": [worst[k][1]], "vec": [worst[k][2]]})

    parts = materialize(cells.mapInPandas(run, f"k int, s array<double>, miss double, cell_id {kind}, vec array<double>"), "mixture-sums")
    far = {r["k"]: r["far"] for r in parts.groupBy("k").agg(F.max_by(F.struct("cell_id", "vec"), F.struct("miss", "cell_id")).alias("far")).collect()}
    out = {}
    for r in _added_up(parts, ["k"]):
        k, v, m = r["k"], np.array(r["s"]), len(w[r["k"]])
        out[k] = v[: m * m].reshape(m, m), v[m * m :].reshape(m, -1), (far[k]["cell_id"], np.array(far[k]["vec"]))
    return out


def _lowest(cells: DataFrame, slopes: dict[int, np.ndarray]) -> list:
    """(k, arch, cell_id, vec, slope): for each row of ``slopes`` the ADDED cells of the least product with it."""
    kind = dict(cells.dtypes)["cell_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, g in _depths(b, list(slopes)):
                x = np.stack(g["vec"].to_numpy()).astype(float)
                value = x @ slopes[k].T
                m = min(ADDED, len(x))
                pick = np.argpartition(value, m - 1, axis=0)[:m]
                for j in range(pick.shape[1]):
                    at = pick[:, j]
                    yield pd.DataFrame({"k": k, "arch": j, "cell_id": g["cell_id"].to_numpy()[at], "vec": list(x[at]), "slope": value[at, j]})

    found = cells.mapInPandas(run, f"k int, arch int, cell_id {kind}, vec array<double>, slope double")
    order = Window.partitionBy("k", "arch").orderBy("slope", "cell_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= ADDED).collect()


class _Pool:
    """The cells of one depth that carry its archetypes or may do so, and the archetypes as their mixtures."""

    def __init__(self, ids: list, x: np.ndarray, w: np.ndarray):
        self.ids, self.x, self.w, self.c = list(ids), x, w, np.zeros((len(w), len(ids)))

    def add(self, cell_id, vec: np.ndarray) -> bool:
        if cell_id in self.ids:
            return False
        self.ids.append(cell_id)
        self.x = np.vstack([self.x, vec])
        return True

    def sweep(self, g: np.ndarray, hx: np.ndarray, worst: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(C, archetypes, slopes) after each archetype in turn is the nearest mixture of the pool."""
        w, c, slopes = self.w.copy(), np.zeros((len(self.w), len(self.ids))), np.zeros_like(self.w)
        for j in range(len(w)):
            if g[j, j] < 1e-7:
                c[j, self.ids.index(worst[0])] = 1
                w[j] = worst[1]
                continue
            target = w[j] + (hx[j] - g[j] @ w) / g[j, j]
            c[j] = simplex_least_squares(self.x, target[None], 2000)[0]
            w[j] = c[j] @ self.x
            slopes[j] = w[j] - target
        return c, w, slopes

    def prune(self) -> None:
        on = (self.c > 0).any(axis=0)
        self.ids, self.x, self.c = [i for i, u in zip(self.ids, on, strict=True) if u], self.x[on], self.c[:, on]


def _fit_spread(cells: DataFrame, pools: dict[int, _Pool], rounds: int) -> None:
    """The rounds of ``archetypal_analysis`` over all cells. A mixture is found among the pool's cells;
    a pass then looks through all cells for such as would improve it, until none does."""
    for _ in range(rounds):
        sums = _mixture_sums(cells, {k: p.w for k, p in pools.items()})
        for k, p in pools.items():
            p.add(*sums[k][2])
        open_, swept = list(pools), {}
        while open_:
            for k in open_:
                swept[k] = pools[k].sweep(*sums[k])
            grown = set()
            for r in _lowest(cells, {k: swept[k][2] for k in open_}):
                _, w, slopes = swept[r["k"]]
                if float(w[r["arch"]] @ slopes[r["arch"]]) - r["slope"] > GAP and pools[r["k"]].add(r["cell_id"], np.array(r["vec"])):
                    grown.add(r["k"])
            open_ = [k for k in open_ if k in grown]
        for k, p in pools.items():
            p.c, p.w, _ = swept[k]
            p.prune()


def _shifted(cells: DataFrame, w: dict[int, np.ndarray], lam: float) -> DataFrame:
    """(k, cell_id, batch, raw, vec): ``raw`` less its batch terms, as ``_ridge_shift`` has them, scaled to
    absolute sum 1."""
    kind, batch_kind = dict(cells.dtypes)["cell_id"], dict(cells.dtypes)["batch"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for k, g in _depths(b, list(w)):
                h = simplex_least_squares(w[k], np.stack(g["vec"].to_numpy()).astype(float))
                x = np.stack(g["raw"].to_numpy()).astype(float)
                for level in g["batch"].unique():
                    on = (g["batch"] == level).to_numpy()
                    total[k, level] = total.get((k, level), 0) + np.concatenate([h[on].sum(0), (h[on].T @ x[on]).ravel()])
        for (k, level), v in total.items():
            yield pd.DataFrame({"k": [k], "batch": [level], "s": [v.tolist()]})

    found = {(r["k"], r["batch"]): np.array(r["s"]) for r in _added_up(cells.mapInPandas(sums, f"k int, batch {batch_kind}, s array<double>"), ["k", "batch"])}
    levels = sorted({b for _, b in found})
    terms: dict[int, np.ndarray] = {}
    for k in w:
        m = len(w[k])
        weight = np.stack([found[k, b][:m] for b in levels])
        mixed = np.stack([found[k, b][m:].reshape(m, -1) for b in levels])
        beta = []
        for j in range(m):
            a = np.diag(np.concatenate([[weight[:, j].sum()], weight[:, j]])) + lam * np.eye(len(levels) + 1)
            a[0, 1:] = a[1:, 0] = weight[:, j]
            beta.append(np.linalg.solve(a, np.vstack([mixed[:, j].sum(0), mixed[:, j]]))[1:])
        terms[k] = np.stack(beta, axis=1)  # batch, archetype, dimension

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {b: i for i, b in enumerate(levels)}
        for b in batches:
            for k, g in _depths(b, list(w)):
                h = simplex_least_squares(w[k], np.stack(g["vec"].to_numpy()).astype(float))
                x = np.stack(g["raw"].to_numpy()).astype(float)
                fixed = x.copy()
                code = g["batch"].map(at).to_numpy()
                for i in np.unique(code):
                    fixed[code == i] -= h[code == i] @ terms[k][i]
                fixed /= np.maximum(np.abs(fixed).sum(1, keepdims=True), 1e-300)
                yield pd.DataFrame({"k": k, "cell_id": g["cell_id"].to_numpy(), "batch": g["batch"].to_numpy(), "raw": list(x), "vec": list(fixed)})

    return materialize(cells.mapInPandas(move, f"k int, cell_id {kind}, batch {batch_kind}, raw array<double>, vec array<double>"), "shifted")


def _spread_archetypes(unit: DataFrame, k_min: int, k_max: int, correction_rounds: int, lam: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """``archetypes`` by passes over all cells; all depths share a pass."""
    spark, kind = unit.sparkSession, dict(unit.dtypes)["cell_id"]
    depths = list(range(k_min, max(k_min, k_max) + 1))
    picked = successive_projection(unit.select("cell_id", "vec"), depths[-1])
    start = picked.join(unit.select("cell_id", "vec"), "cell_id").orderBy("step").collect()
    ids, x = [r["cell_id"] for r in start], np.array([r["vec"] for r in start])
    pools = {k: _Pool(ids[:k], x[:k], x[:k].copy()) for k in depths}
    _fit_spread(unit.select("cell_id", "vec"), pools, rounds)
    cells = unit.withColumn("raw", F.col("vec"))
    for _ in range(correction_rounds):
        cells = _shifted(cells, {k: p.w for k, p in pools.items()}, lam)
        wanted = spark.createDataFrame([(k, i) for k, p in pools.items() for i in p.ids], f"k int, cell_id {kind}")
        moved = {(r["k"], r["cell_id"]): r["vec"] for r in cells.join(F.broadcast(wanted), ["k", "cell_id"]).select("k", "cell_id", "vec").collect()}
        for k, p in pools.items():
            p.x = np.array([moved[k, i] for i in p.ids])
            p.w = p.c @ p.x
        _fit_spread(cells.select("k", "cell_id", "vec"), pools, rounds)
    c = [(k, j + 1, p.ids[i], float(p.c[j, i])) for k, p in pools.items() for j, i in zip(*np.nonzero(p.c > 1e-9), strict=True)]
    c = [(k, int(j), i, v) for k, j, i, v in c]
    w = {k: p.w for k, p in pools.items()}

    def regress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, g in _depths(b, list(w)):
                h = simplex_least_squares(w[k], np.stack(g["vec"].to_numpy()).astype(float))
                i, j = np.nonzero(h > 1e-9)
                yield pd.DataFrame({"k": k, "arch": (j + 1).astype(np.int32), "cell_id": g["cell_id"].to_numpy()[i], "value": h[i, j]})

    schema = f"k int, arch int, cell_id {kind}, value double"
    return spark.createDataFrame(c, schema), materialize(cells.mapInPandas(regress, schema), "archetype-h")


def stacked_points(c: DataFrame, cells: DataFrame) -> dict[int, np.ndarray]:
    """Archetype vectors of each depth: C times the cells, a few short rows."""
    dims = linalg.dense(cells, "cell_id", "vec").withColumnRenamed("value", "x")
    rows = c.join(dims, "cell_id").groupBy("k", "arch", "dim").agg(F.sum(F.col("value") * F.col("x")).alias("x")).orderBy("k", "arch", "dim").collect()
    out: dict[int, dict[int, list[float]]] = {}
    for r in rows:
        out.setdefault(r["k"], {}).setdefault(r["arch"], []).append(r["x"])
    return {k: np.array([v for _, v in sorted(a.items())]) for k, a in out.items()}


def landmark_cells(c: DataFrame, h: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(arch, cell_id): for each archetype, of the cells whose H is within ``tolerance`` of its largest and
    whose C is positive, the one with the largest C. Archetypes without one are absent."""
    top = F.max("value").over(Window.partitionBy("arch"))
    near = h.withColumn("top", top).where(F.col("value") >= F.col("top") - tolerance).select("arch", "cell_id")
    both = c.where("value > 0").join(near, ["arch", "cell_id"])
    order = Window.partitionBy("arch").orderBy(F.desc(F.round("value", 9)), "cell_id")
    return both.withColumn("r", F.row_number().over(order)).where("r = 1").select("arch", "cell_id")


def reconstruct(assay: DataFrame, c: DataFrame, h: DataFrame, n_cells: int, z_threshold: float = -1.0) -> dict[str, DataFrame]:
    """Archetypes of all depths under one number, without those of low transitivity in their correlation
    graph or without a landmark: selected(arch, k, depth_arch), c, h, backbone, landmarks, profile."""
    names = c.select("k", F.col("arch").alias("a")).distinct().withColumn("arch", F.row_number().over(Window.orderBy("k", "a")).cast("int"))
    names = materialize(names, "stacked-names")
    cs, hs = (m.withColumnRenamed("arch", "a").join(F.broadcast(names), ["k", "a"]).select("arch", "cell_id", "value") for m in (c, h))
    cs, hs = materialize(cs, "stacked-c"), materialize(hs, "stacked-h")
    cor = linalg.correlation(hs, "cell_id", "arch", n_cells).where("value > 0")
    backbone = materialize(cor.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("value").alias("weight")).union(cor.select("b", "a", "value")), "backbone")
    t = graph.transitivity(backbone)
    s = t.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    low = t.crossJoin(F.broadcast(s)).where(ratio(F.col("value") - F.col("m"), F.col("s")) < z_threshold).select(F.col("v").alias("arch"))
    marks = landmark_cells(cs, hs)
    kept = materialize(names.join(low, "arch", "left_anti").join(marks, "arch", "left_semi"), "selected")
    only = kept.select("arch")
    cs, hs = cs.join(F.broadcast(only), "arch", "left_semi"), hs.join(F.broadcast(only), "arch", "left_semi")
    inner = backbone.join(F.broadcast(only.toDF("src")), "src", "left_semi").join(F.broadcast(only.toDF("dst")), "dst", "left_semi")
    profile = linalg.product(assay, cs, "cell_id", "feature_id", "arch")
    return {"selected": kept.select("arch", "k", F.col("a").alias("depth_arch")), "c": cs, "h": hs, "backbone": inner, "landmarks": marks.join(only, "arch", "left_semi"), "profile": profile}


def unify(cells: DataFrame, c: DataFrame, n_dims: int, resolution: float = 1.5, min_cells: int = 5) -> dict[str, DataFrame]:
    """Archetypes merged to core states: modules(arch, state) of their correlated profiles, c_core, h_core
    by simplex regression, and assignments(cell_id, state, confidence)."""
    wide = c.where("value > 0").groupBy("arch").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells).select("arch")
    c = materialize(c.join(F.broadcast(wide), "arch", "left_semi"), "supported-c")
    dims = linalg.dense(cells, "cell_id", "vec").withColumnRenamed("value", "x")
    points = materialize(c.join(dims, "cell_id").groupBy("arch", "dim").agg(F.sum(F.col("value") * F.col("x")).alias("value")), "points")
    cor = linalg.correlation(points, "dim", "arch", n_dims).where("value > 0")
    edges = cor.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("value").alias("weight"))
    edges = materialize(edges.union(edges.select("dst", "src", "weight")), "module-edges")
    found = graph.communities(edges, c.select(F.col("arch").alias("v")).distinct(), resolution)
    codes = found.select("label").distinct().withColumn("state", F.row_number().over(Window.orderBy("label")).cast("int"))
    modules = materialize(found.join(codes, "label").select(F.col("v").alias("arch"), "state"), "modules")
    size = modules.groupBy("state").agg(F.count("*").alias("size"))
    core = c.join(modules, "arch").groupBy("state", "cell_id").agg(F.sum("value").alias("s")).join(size, "state").select(F.col("state").alias("arch"), "cell_id", (F.col("s") / F.col("size")).alias("value"))
    core = materialize(core, "core-c")
    w = stacked_points(core.withColumn("k", F.lit(0)), cells)[0]
    h = materialize(simplex_regression(cells, w), "core-h")
    order = Window.partitionBy("cell_id").orderBy(F.desc(F.round("value", 9)), "arch")
    best = h.withColumn("r", F.row_number().over(order)).where("r = 1").select("cell_id", F.col("arch").alias("state"), F.col("value").alias("confidence"))
    return {"modules": modules, "c_core": core, "h_core": h, "assignments": best}


def orthogonal_part(a: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Columns of ``a`` standardized, less their projection on the standardized columns of ``s``, standardized."""

    def scale(m: np.ndarray) -> np.ndarray:
        d = m.std(axis=0, ddof=1)
        return (m - m.mean(axis=0)) / np.where(d > 0, d, 1)

    q = np.linalg.qr(scale(s))[0]
    z = scale(a)
    return scale(z - q @ (q.T @ z))


def _moved(cells: DataFrame, pairs: DataFrame, width: float) -> DataFrame:
    """``cells(cell_id, vec)`` moved by the kernel average of vx - vy over ``pairs(x, y, vx, vy)``. The shifts of one y
    are added up, and blocks of these pass each block of cells."""
    kind, dims = dict(cells.dtypes)["cell_id"], int(cells.select(F.size("vec")).first()[0])
    total = F.aggregate(F.collect_list("vx"), F.array_repeat(F.lit(0.0), dims), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
    by_cell = pairs.groupBy("y").agg(F.first("vy").alias("vy"), total.alias("sum"), F.count("*").cast("double").alias("n"))
    shifts = materialize(by_cell.select(F.col("y").alias("cell_id"), F.concat("vy", F.zip_with("sum", "vy", lambda s, v: s - F.col("n") * v), F.array("n")).alias("p")), "shifts")
    spots = shifts.select(F.col("p")[2 * dims].alias("n"), F.posexplode(F.slice("p", 1, dims)).alias("dim", "v"))
    mean = spots.groupBy("dim").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean"))
    gap = F.col("v") - F.col("mean")
    var = spots.join(F.broadcast(mean), "dim").groupBy("dim").agg((F.sum(F.col("n") * gap * gap) / F.sum("n")).alias("var")).agg(F.sum("var")).first()[0]
    scale = width * max(float(var), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            out = x + moved / weight[:, None]
            offsets = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_pydict({"cell_id": own, "vec": pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))})

        own = None
        for b in batches:
            mine, raw, ids, p = (b.column(c) for c in ("l_ids", "l_p", "ids", "p"))
            for r in range(b.num_rows):
                if mine[r].is_valid:
                    if own is not None:
                        yield from close()
                    own = mine[r].values
                    x = np.frombuffer(raw[r].as_buffer(), float).reshape(len(own), -1).copy()
                    least, moved, weight = np.full(len(x), np.inf), np.zeros(x.shape), np.zeros(len(x))
                y = np.frombuffer(p[r].as_buffer(), float).reshape(len(ids[r].values), -1)
                at, shift, n = y[:, :dims], y[:, dims:-1], y[:, -1]
                d = (x * x).sum(1)[:, None] + (at * at).sum(1)[None] - 2 * x @ at.T
                low = np.minimum(least, d.min(axis=1))
                old = np.exp(-(least - low) / scale)
                g = np.exp(-(d - low[:, None]) / scale)
                moved, weight, least = moved * old[:, None] + g @ shift, weight * old + g @ n, low
        if own is not None:
            yield from close()

    left = graph._blocks(cells.select("cell_id", F.col("vec").alias("p")), finite=False)
    return graph._against(left, graph._blocks(shifts)).mapInArrow(run, f"cell_id {kind}, vec array<double>")


def mutual_neighbours_correction(cells: DataFrame, batches: DataFrame, k: int = 20, width: float = 0.1) -> DataFrame:
    """(cell_id, vec): batches merged in turn, the largest first: pairs that are among each other's k
    nearest give shifts, and each cell moves by their kernel average."""
    kind = dict(cells.dtypes)["cell_id"]
    order = [r["batch"] for r in batches.groupBy("batch").count().orderBy(F.desc("count"), "batch").collect()]
    placed = cells.join(batches.select("cell_id", "batch"), "cell_id").select("cell_id", F.transform(F.col("vec").cast("array<double>"), lambda x: x).alias("vec"), "batch")
    merged = materialize(placed.where(F.col("batch") == order[0]).select("cell_id", "vec"), "merged")
    for b in order[1:]:
        new = materialize(placed.where(F.col("batch") == b).select("cell_id", "vec"), "joining")
        old, fresh = (m.select("cell_id", F.col("vec").alias("p")) for m in (merged, new))
        a = graph.nearest(old, k, "l2", targets=fresh).select(F.col("cell_id").alias("x"), F.col("neighbour").alias("y"))
        c = graph.nearest(fresh, k, "l2", targets=old).select(F.col("cell_id").alias("y"), F.col("neighbour").alias("x"))
        pairs = materialize(a.join(c, ["x", "y"]), "mutual")
        if not pairs.isEmpty():
            new = _moved(new, pairs.join(merged.toDF("x", "vx"), "x").join(new.toDF("y", "vy"), "y"), width)
        merged = materialize(merged.unionByName(new), "merged")
    return merged
