"""Sparse algebra on long-form matrices: products are joins, marginals are hash aggregates, and zeros
are never stored. Means and variances divide by the full dimension, not by the stored entries."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import ratio
from quillon.tables import materialize


def marginals(assay: DataFrame, by: str, n: int) -> DataFrame:
    """(by, total, squares, mean, nnz, top): sums of a row or column of length ``n``; top counts zeros."""
    return assay.groupBy(by).agg(
        F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"), (F.sum("value") / F.lit(float(n))).alias("mean"),
        F.count_if(F.col("value") != 0).alias("nnz"), F.greatest(F.max("value"), F.lit(0.0)).alias("top"),
    )


def product(a: DataFrame, b: DataFrame, on: str, left: str, right: str) -> DataFrame:
    """(left, right, value): sum over ``on`` of a's times b's values."""
    x, y = a.select(on, left, F.col("value").alias("__a")), b.select(on, right, F.col("value").alias("__b"))
    return x.join(y, on).groupBy(left, right).agg(F.sum(F.col("__a") * F.col("__b")).alias("value"))


def l1_normalize(assay: DataFrame, by: str = "cell_id") -> DataFrame:
    total = F.sum(F.abs("value")).over(Window.partitionBy(by))
    return assay.withColumn("value", ratio(F.col("value"), total))


def l2_normalize(assay: DataFrame, by: str = "cell_id") -> DataFrame:
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(by)))
    return assay.withColumn("value", ratio(F.col("value"), norm))


def dense(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, value) of array vectors, every dimension stored."""
    return vectors.select(id_col, F.posexplode(F.col(vec_col).cast("array<double>")).alias("dim", "value"))


def zscore(rows: DataFrame, by: str = "dim") -> DataFrame:
    """Dense rows standardized within ``by`` with the n - 1 deviation; 0 where it is 0."""
    s = rows.groupBy(by).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return rows.join(s, by).withColumn("value", ratio(F.col("value") - F.col("m"), F.col("s"))).drop("m", "s")


#: Columns up to which correlation joins rows with themselves, and stored entries of a block of columns beyond.
FEW_COLUMNS, ENTRIES = 1024, 2_500_000


def correlation(assay: DataFrame, over: str, of: str, n: int) -> DataFrame:
    """(a, b, value) for a < b: Pearson correlation of the columns ``of`` across ``n`` rows ``over``, zeros
    included, from sums alone. Columns without a shared row correlate by their marginals.

    Beyond a few columns the pairs are made block by block: a task gets the rows that have a column of its block,
    from that column on, and writes the block's pairs as they are; pairs are neither joined nor shuffled."""
    if assay.select(of).distinct().limit(FEW_COLUMNS + 1).count() > FEW_COLUMNS:
        return _blocked_correlation(assay, over, of, n)
    m = assay.groupBy(of).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    x = assay.select(over, F.col(of).alias("a"), F.col("value").alias("x"))
    y = assay.select(over, F.col(of).alias("b"), F.col("value").alias("y"))
    xy = x.join(y, over).where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    pairs = m.toDF("a", "sa", "qa").join(m.toDF("b", "sb", "qb"), F.col("a") < F.col("b")).join(xy, ["a", "b"], "left")
    size = F.lit(float(n))
    cov = size * F.coalesce("xy", F.lit(0.0)) - F.col("sa") * F.col("sb")
    scale = F.sqrt((size * F.col("qa") - F.col("sa") * F.col("sa")) * (size * F.col("qb") - F.col("sb") * F.col("sb")))
    return pairs.select("a", "b", ratio(cov, scale).alias("value"))


def _blocked_correlation(assay: DataFrame, over: str, of: str, n: int) -> DataFrame:
    kind = dict(assay.dtypes)[of]
    entry = F.struct(F.col(of).alias("c"), F.col("value").cast("double").alias("x"))
    lists = materialize(assay.where(F.col(of).isNotNull()).groupBy(over).agg(F.collect_list(entry).alias("e")).select("e"), "rows")
    flat = lists.select(F.explode("e").alias("e")).select("e.c", "e.x")
    stats = flat.groupBy("c").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("k")).orderBy("c").toArrow()
    ids = stats.column("c").combine_chunks()
    s, q = (stats.column(c).to_numpy() for c in ("s", "q"))
    columns, blocks = len(ids), max(16, -(-int(stats.column("k").to_numpy().sum()) // ENTRIES))
    cuts = np.unique((columns * (1 - np.sqrt(1 - np.arange(blocks + 1) / blocks))).astype(int))  # as many pairs in each
    place = ids.to_numpy(zero_copy_only=False)
    place = np.array(place.tolist(), dtype=str) if place.dtype == object else place

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column("e")
            if not b.num_rows:
                continue
            sizes = pc.list_value_length(e).to_numpy(zero_copy_only=False).astype(np.int64)
            inner = e.flatten()
            c = inner.field("c").to_numpy(zero_copy_only=False)
            p = np.searchsorted(place, np.array(c.tolist(), dtype=str) if c.dtype == object else c).astype(np.int32)
            x = inner.field("x").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((p, row))
            p, x, end = p[order], x[order], np.cumsum(sizes)
            block = np.searchsorted(cuts, p, "right") - 1
            first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (row[1:] != row[:-1])]))
            for g in np.unique(block[first]).tolist():
                lo = first[block[first] == g]
                length = end[row[lo]] - lo
                take = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                raw = length.astype(np.int32).tobytes() + p[take].tobytes() + x[take].tobytes()
                yield pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int32()), "rows": pa.array([len(lo)], pa.int32()), "raw": pa.array([zlib.compress(raw, 1)], pa.binary())})

    def block_pairs(g: int, parts: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        lengths, ps, xs = [], [], []
        while parts:
            k, raw = parts.pop()
            raw = zlib.decompress(raw)
            lengths.append(np.frombuffer(raw, np.int32, k))
            total = int(lengths[-1].sum())
            ps.append(np.frombuffer(raw, np.int32, total, 4 * k))
            xs.append(np.frombuffer(raw[4 * (k + total) :], float, total))
        p, x = (np.concatenate(v) if v else np.empty(0, t) for v, t in ((ps, np.int32), (xs, float)))
        stop = np.cumsum(np.concatenate(lengths)) if lengths else np.empty(0, int)
        lo, hi = int(cuts[g]), int(cuts[g + 1])
        mine = np.flatnonzero(p < hi)
        mine = mine[np.argsort(p[mine], kind="stable")]
        ends, key = stop[np.searchsorted(stop, mine, "right")] if len(mine) else mine, p[mine]
        step = max(1, 4_000_000 // columns)
        for a in range(lo, hi, step):
            z = min(a + step, hi)
            width = columns - a
            xy = np.zeros((z - a) * width)
            span = np.arange(*np.searchsorted(key, [a, z]))
            for some in np.array_split(span, 1 + int((ends[span] - mine[span]).sum()) // 2_000_000):
                start, length = mine[some], ends[some] - mine[some]
                if not len(start):
                    continue
                take = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                where = np.repeat((p[start] - a).astype(np.int64) * width, length) + (p[take] - a)
                np.add.at(xy, where, np.repeat(x[start], length) * x[take])
            xy = xy.reshape(z - a, width)
            for i in range(a, z):
                j = slice(i + 1, columns)
                cov = n * xy[i - a, i + 1 - a :] - s[i] * s[j]
                with np.errstate(invalid="ignore", divide="ignore"):
                    scale = np.sqrt((n * q[i] - s[i] * s[i]) * (n * q[j] - s[j] * s[j]))
                    value = np.where((scale != 0) & np.isfinite(scale), cov / scale, 0.0)
                for w in range(0, len(value), 1 << 20):
                    some = value[w : w + (1 << 20)]
                    yield pa.RecordBatch.from_pydict({"a": pa.array([ids[i].as_py()] * len(some) if not pa.types.is_integer(ids.type) else np.full(len(some), place[i]), ids.type), "b": ids.slice(i + 1 + w, len(some)), "value": pa.array(some)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for g, k, raw in zip(*(b.column(c).to_pylist() for c in ("g", "rows", "raw")), strict=True):
                if now is not None and g != now:
                    yield from block_pairs(now, parts)
                    parts = []
                now = g
                if k:
                    parts.append((k, raw))
        if now is not None:
            yield from block_pairs(now, parts)

    dealt = lists.mapInArrow(deal, "g int, rows int, raw binary")
    every = lists.sparkSession.range(len(cuts) - 1).select(F.col("id").cast("int").alias("g"), F.lit(0).alias("rows"), F.lit(b"").alias("raw"))
    return dealt.union(every).repartition(max(1, len(cuts) - 1), "g").sortWithinPartitions("g").mapInArrow(run, f"a {kind}, b {kind}, value double")


def outer(p: DataFrame, q: DataFrame) -> DataFrame:
    """The outer product of two short vectors (id_p, p) and (id_q, q)."""
    return p.crossJoin(q).withColumn("value", F.col("p") * F.col("q"))
