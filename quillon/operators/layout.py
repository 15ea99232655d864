"""Layout of a graph in two or three dimensions, and colours from it.

The optimization is sequential by nature (each move depends on those before), so it runs in one task on
the edge list of one graph; everything before and after it is distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import color
from quillon.functions.scalars import ratio
from quillon.operators import graph

NEGATIVES, CLAMP = 5, 4.0


def curve(compactness: float) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a d^(2b)) fitted to a plateau of (1 - compactness / 100) + 0.01 and an exponential
    tail, by Gauss-Newton steps."""
    least = 0.01 + (1 - min(max(compactness, 0.0), 100.0) / 100.0) * 0.5
    d = np.linspace(0.01, 3, 300)
    y = np.where(d < least, 1.0, np.exp(-(d - least)))
    a, b = 1.0, 1.0
    for _ in range(200):
        t = d ** (2 * b)
        f = 1 / (1 + a * t)
        j = np.stack([-t * f * f, -a * t * 2 * np.log(d) * f * f], axis=1)
        step = np.linalg.lstsq(j, y - f, rcond=None)[0]
        a, b = max(1e-3, a + 0.5 * step[0]), min(max(0.2, b + 0.5 * step[1]), 3.0)
    return float(a), float(b)


def smooth_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): memberships exp(-(d - rho) / sigma), sigma such that they sum to log2 of the
    degree, by 64 bisections a vertex in one expression; d = 1 - weight. ``edges`` may be lists by dst, whose edges
    stay in their rows."""
    if graph._as_lists(edges):
        d = edges.select("dst", "src", "weight", F.transform("weight", lambda w: 1.0 - w).alias("d"))
    else:
        d = edges.groupBy("dst").agg(F.collect_list(1.0 - F.col("weight")).alias("d"))
    d = d.withColumn("rho", F.array_min("d")).withColumn("goal", F.log2(F.greatest(F.size("d"), F.lit(2)).cast("double")))

    def total(s):
        return F.aggregate("d", F.lit(0.0), lambda t, x: t + F.exp(-F.greatest(F.lit(0.0), x - F.col("rho")) / s))

    bounds = F.struct(F.lit(1e-6).alias("lo"), F.lit(1e3).alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        low = total(mid) < F.col("goal")
        return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

    s = d.withColumn("sigma", F.aggregate(F.sequence(F.lit(1), F.lit(40)), bounds, halve, lambda a: (a["lo"] + a["hi"]) / 2))
    edges = graph.unroll_with(s, "rho", "sigma") if graph._as_lists(edges) else edges.join(s.select("dst", "rho", "sigma"), "dst")
    w = F.exp(-F.greatest(F.lit(0.0), (1.0 - F.col("weight")) - F.col("rho")) / F.col("sigma"))
    return edges.select("src", "dst", F.greatest(F.lit(1e-16), w).alias("weight"))


def optimize(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, start: np.ndarray, a: float, b: float, epochs: int, seed: int = 0) -> np.ndarray:
    """Stochastic gradient descent over edges in proportion to weight, with negative samples, the step
    falling to 0. Edges due in an epoch move together."""
    rng, x = np.random.default_rng(seed), start.astype(float).copy()
    if not len(weight):
        return x
    every = weight.max() / np.maximum(weight, 1e-12)
    live = every <= epochs
    src, dst, every = src[live], dst[live], every[live]
    due = every.copy()
    for epoch in range(1, epochs + 1):
        rate = 1.0 - (epoch - 1) / epochs
        now = np.flatnonzero(due <= epoch)
        i, j = src[now], dst[now]
        d = x[i] - x[j]
        q = np.maximum((d * d).sum(1), 1e-12)
        g = np.clip((-2 * a * b * q ** (b - 1) / (1 + a * q**b))[:, None] * d, -CLAMP, CLAMP) * rate
        np.add.at(x, i, g)
        np.add.at(x, j, -g)
        for _ in range(NEGATIVES):
            k = rng.integers(0, len(x), len(i))
            d = x[i] - x[k]
            q = (d * d).sum(1)
            push = np.clip((2 * b / ((0.001 + q) * (1 + a * q**b)))[:, None] * d, -CLAMP, CLAMP) * rate
            push[i == k] = 0
            np.add.at(x, i, push)
        due[now] += every[now]
    return x


def layout(edges: DataFrame, reduced: DataFrame, compactness: float = 50.0, epochs: int = 100, seed: int = 0) -> DataFrame:
    """(cell_id, x, y, x3, y3, z3): coordinates standardized by axis, from the first three components of
    ``reduced(cell_id, vec)``."""
    smooth = smooth_weights(edges)  # each vertex's nearest neighbour has weight 1
    smooth = smooth.where(1.0 / F.greatest(F.col("weight"), F.lit(1e-12)) <= F.lit(float(epochs)))  # others are never due
    kind = dict(reduced.dtypes)["cell_id"]
    null = F.lit(None)
    rows = smooth.select("src", "dst", "weight", null.cast("array<double>").alias("vec")).union(reduced.select("cell_id", null.cast(kind), null.cast("double"), F.slice(F.col("vec").cast("array<double>"), 1, 3)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(batches))
        cells = t[t["dst"].isna()].sort_values("src")
        links = t[t["dst"].notna()].sort_values(["src", "dst"])
        ids = cells["src"].to_numpy()
        start = np.stack(cells["vec"].to_numpy())
        sd = start.std(axis=0, ddof=1)
        start = (start - start.mean(axis=0)) / np.where(sd > 0, sd, 1)
        i, j = (np.searchsorted(ids, links[c].to_numpy().astype(ids.dtype)) for c in ("src", "dst"))
        w = links["weight"].to_numpy()
        a, b = curve(compactness)
        flat = optimize(i, j, w, start[:, :2], a, b, epochs, seed)
        deep = optimize(i, j, w, np.column_stack([flat, start[:, 2:3]]), a, b, epochs, seed + 1)
        both = np.column_stack([flat, deep])
        both = (both - both.mean(axis=0)) / np.where(both.std(axis=0) > 0, both.std(axis=0, ddof=1), 1)
        yield pd.DataFrame({"cell_id": ids, **{n: both[:, k] for k, n in enumerate(("x", "y", "x3", "y3", "z3"))}})

    return rows.repartition(1).mapInPandas(run, f"cell_id {kind}, x double, y double, x3 double, y3 double, z3 double")


def cell_colors(coords: DataFrame) -> DataFrame:
    """(cell_id, r, g, b, hex): lightness 25 to 75 by depth, hue by the plane, as CIELAB."""
    m = coords.agg(F.max(F.abs("x3")).alias("mx"), F.max(F.abs("y3")).alias("my"), F.min("z3").alias("lo"), F.max("z3").alias("hi"))
    c = coords.crossJoin(F.broadcast(m))
    lab = (25 + 50 * ratio(F.col("z3") - F.col("lo"), F.col("hi") - F.col("lo")), 128 * ratio("x3", "mx"), 128 * ratio("y3", "my"))
    rgb = tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for v in color.lab_to_rgb(lab))
    return c.select("cell_id", *[v.alias(n) for v, n in zip(rgb, "rgb", strict=True)], color.hex_color(rgb).alias("hex"))


def blend_colors(weights: DataFrame, colors: DataFrame) -> DataFrame:
    """(group, r, g, b): weighted means in CIELAB of cells' colours for ``weights(cell_id, group, weight)``."""
    lab = color.rgb_to_lab((F.col("r"), F.col("g"), F.col("b")))
    c = colors.select("cell_id", *[v.alias(n) for v, n in zip(lab, ("l", "ca", "cb"), strict=True)])
    j = weights.join(c, "cell_id").groupBy("group").agg(*[ratio(F.sum(F.col("weight") * F.col(n)), F.sum("weight")).alias(n) for n in ("l", "ca", "cb")])
    rgb = color.lab_to_rgb((F.col("l"), F.col("ca"), F.col("cb")))
    return j.select("group", *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)).alias(n) for v, n in zip(rgb, "rgb", strict=True)])


def palette(colors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(n, hex): k colours that represent ``colors(r, g, b)``, by k-means in CIELAB."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    lab = color.rgb_to_lab((F.col("r"), F.col("g"), F.col("b")))
    x = colors.select(array_to_vector(F.array(*lab)).alias("features"))
    centres = KMeans(k=k, seed=seed).fit(x).clusterCenters()
    spark = colors.sparkSession
    rows = spark.createDataFrame([(i + 1, *map(float, c)) for i, c in enumerate(sorted(map(tuple, centres)))], "n int, l double, ca double, cb double")
    rgb = tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for v in color.lab_to_rgb((F.col("l"), F.col("ca"), F.col("cb"))))
    return rows.select("n", color.hex_color(rgb).alias("hex"))


def plot_cells(coords: DataFrame, labels: DataFrame, colors: DataFrame, attribute: DataFrame | None = None, threshold: float = -0.5, power: float = 2.0) -> DataFrame:
    """(cell_id, x, y, label, hex, alpha): what a scatter plot of cells needs; ``attribute(cell_id, value)``
    fades cells below a standardized threshold."""
    from quillon.functions.scalars import opacity

    out = coords.join(labels.select("cell_id", "label"), "cell_id", "left").join(colors.select("cell_id", "hex"), "cell_id", "left")
    if attribute is None:
        return out.withColumn("alpha", F.lit(1.0)).select("cell_id", "x", "y", "label", "hex", "alpha")
    s = attribute.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = attribute.crossJoin(F.broadcast(s)).select("cell_id", opacity(ratio(F.col("value") - F.col("m"), F.col("s")), threshold, power).alias("alpha"))
    return out.join(z, "cell_id", "left").select("cell_id", "x", "y", "label", "hex", "alpha")


def label_anchors(coords: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, x, y): medians of the cells of each label."""
    return coords.join(labels.where("label is not null"), "cell_id").groupBy("label").agg(F.median("x").alias("x"), F.median("y").alias("y"))


def gradient(values: DataFrame, nonparametric: bool = False) -> DataFrame:
    """(cell_id, value): negatives as 0, log1p above 50, or average ranks over the count."""
    v = values.withColumn("value", F.greatest("value", F.lit(0.0)))
    if nonparametric:
        every = Window.partitionBy(F.lit(0))
        tied = F.count("*").over(Window.partitionBy("value"))
        rank = F.rank().over(every.orderBy("value")) + (tied - 1) / 2
        return v.select("cell_id", (rank / F.count("*").over(every)).alias("value"))
    top = v.agg(F.max("value").alias("top"))
    return v.crossJoin(F.broadcast(top)).select("cell_id", F.when(F.col("top") > 50, F.log1p("value")).otherwise(F.col("value")).alias("value"))


def feature_view(scores: DataFrame, state_coords: DataFrame, state_colors: DataFrame, top: int = 5) -> DataFrame:
    """(feature_id, x, y, hex): top features of each state, placed and coloured by doubly normalized scores."""
    from quillon.operators.specificity import differential_scores, double_norm

    t = double_norm(differential_scores(scores, top).select("feature_id", "group", F.col("significance").alias("value")), "feature_id", "group")
    lab = color.rgb_to_lab((F.col("r"), F.col("g"), F.col("b")))
    s = state_coords.join(state_colors.select("group", *[v.alias(n) for v, n in zip(lab, ("l", "ca", "cb"), strict=True)]), "group")
    m = t.join(F.broadcast(s), "group").groupBy("feature_id").agg(*[ratio(F.sum(F.col("value") * F.col(n)), F.sum("value")).alias(n) for n in ("x", "y", "l", "ca", "cb")])
    rgb = tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for v in color.lab_to_rgb((F.col("l"), F.col("ca"), F.col("cb"))))
    return m.select("feature_id", "x", "y", color.hex_color(rgb).alias("hex"))


def tooltips(scores: DataFrame, assignments: DataFrame, top: int = 7) -> DataFrame:
    """(cell_id, text): the top features of each cell's state, a line each."""
    from quillon.operators.specificity import top_features

    t = top_features(scores, top).groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature_id"))), lambda x: x["feature_id"].cast("string")), "\n").alias("text"))
    return assignments.join(F.broadcast(t), F.col("state") == F.col("group"), "left").select("cell_id", "text")


def feature_quartiles(assay: DataFrame, labels: DataFrame, feature) -> DataFrame:
    """(label, low, q1, median, q3, high) of a feature over its mean, zeros included: a box plot."""
    x = labels.where("label is not null").join(assay.where(F.col("feature_id") == feature).select("cell_id", "value"), "cell_id", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    m = x.agg(F.avg("value").alias("m"))
    y = x.crossJoin(F.broadcast(m)).withColumn("value", ratio("value", "m"))
    q = F.percentile("value", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return y.groupBy("label").agg(q.alias("q")).select("label", *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def footprint(h: DataFrame, power: float = 3.0) -> DataFrame:
    """(cell_id, arch, value): memberships over the smallest of the effectively present ones, at most 1, to a
    power."""
    order = Window.partitionBy("arch").orderBy(F.desc("value"), "cell_id")
    every = Window.partitionBy("arch")
    q = F.col("value") * F.col("value")
    n = ratio(F.pow(F.sum(q).over(every), F.lit(2.0)), F.sum(q * q).over(every))
    r = h.withColumn("n", F.greatest(F.lit(1), F.round(n))).withColumn("r", F.row_number().over(order))
    r = r.withColumn("base", F.max(F.when(F.col("r") == F.col("n"), F.col("value"))).over(every))
    return r.select("cell_id", "arch", F.pow(F.least(F.lit(1.0), ratio("value", "base")), F.lit(power)).alias("value"))


def row_zscore_table(table: DataFrame, row: str, col: str) -> DataFrame:
    """Heat-map values standardized by row, with ``position`` of columns seriated by 1 - correlation: a
    chain that starts at the most typical column and goes on to the nearest that is left."""
    s = table.groupBy(row).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = table.join(s, row).withColumn("value", ratio(F.col("value") - F.col("m"), F.col("s"))).drop("m", "s")
    kind = dict(table.dtypes)[col]

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(batches))
        w = t.pivot_table(index=row, columns=col, values="value", fill_value=0.0)
        x = w.to_numpy()
        x = x - x.mean(axis=0)
        n = np.linalg.norm(x, axis=0)
        c = (x.T @ x) / np.maximum(np.outer(n, n), 1e-300)
        out, left = [int(c.sum(axis=1).argmax())], set(range(len(c)))
        left.discard(out[0])
        while left:
            nxt = max(left, key=lambda j: (c[out[-1], j], -j))
            out.append(nxt)
            left.discard(nxt)
        yield pd.DataFrame({col: w.columns[out], "position": np.arange(1, len(out) + 1)})

    return z.join(F.broadcast(z.select(row, col, "value").repartition(1).mapInPandas(chain, f"{col} {kind}, position long")), col)
