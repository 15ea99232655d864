"""Connected components of an edge table without gathering a group anywhere.

Each partition first replaces its edges by a spanning star of each component that it sees. While more
than FINISH edges remain, rounds of hooking and pointer jumping contract them across partitions; a
remainder of at most FINISH edges, a few MB, is finished in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.tables import materialize

FINISH = 1_000_000


def smallest_root(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id of the component of each) of the edges a[i] - b[i]."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        p, q = root[x], root[y]
        if (p == q).all():
            return ids, ids[root]
        low = np.minimum(p, q)
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        while (root[root] != root).any():
            root = root[root]


def _stars(edges: DataFrame, loops: bool, rows: int = 2_000_000) -> DataFrame:
    """Edges (a, b) from each vertex of a partition to the smallest it is connected with there; with
    ``loops`` also from the smallest to itself. Partitions of more than ``rows`` edges go by parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def star() -> tuple[np.ndarray, np.ndarray]:
            return smallest_root(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += len(batch)
            if n > rows and not loops:
                ids, root = star()
                yield pa.RecordBatch.from_arrays([pa.array(ids[ids != root]), pa.array(root[ids != root])], names=["a", "b"])
                held, n = [], 0
        if held:
            ids, root = star()
            pick = np.ones(len(ids), bool) if loops else ids != root
            yield pa.RecordBatch.from_arrays([pa.array(ids[pick]), pa.array(root[pick])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, max_rounds: int = 60, finish: int = FINISH) -> DataFrame:
    """(id, root) for each endpoint of ``edges(a, b)``; root is the component's smallest id.

    A round hooks every vertex to its smallest neighbour, halves those paths twice, and rewrites the
    edges between the hooked roots, so they shrink geometrically. The minimum of a vertex's neighbours
    is combined before the shuffle, so a hub costs no more than another vertex. Nulls and loops are
    ignored; an empty table gives an empty result.
    """
    clean = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    live = materialize(_stars(clean.select(F.col("a").cast("long"), F.col("b").cast("long")), False), "cc-edges")
    roots = None
    for _ in range(max_rounds):
        if live.count() <= finish:
            break
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p"))
        hook = materialize(hook, "cc-hook")
        for _ in range(2):
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("q"))
            hook = hook.join(up, "p").select("v", F.col("q").alias("p"))
        hook = materialize(hook, "cc-jump")
        to_a, to_b = hook.toDF("a", "pa"), hook.toDF("b", "pb")
        live = live.join(to_a, "a").join(to_b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        live = materialize(_stars(live.where("a != b").distinct(), False), "cc-edges")
        roots = _through(roots, hook.toDF("id", "root"))
    else:
        raise RuntimeError("components did not settle")
    last = materialize(_stars(live.repartition(1), True).toDF("id", "root"), "cc-roots")
    return last if roots is None else materialize(_through(roots, last), "cc-roots")


def _through(roots: DataFrame | None, step: DataFrame) -> DataFrame:
    """``roots`` after another step of contraction."""
    if roots is None:
        return step
    moved = roots.join(step.toDF("root", "next"), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return materialize(moved, "cc-roots")
