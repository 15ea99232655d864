"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many random directions. An order sorts them by one projection within
cells, the signs of a few others; a query's window is what lies within WINDOW of it there. For each pair
in a window, collisions are counted over COUNTED more projections, whose windows are centred at the
query too. A pair with the calibrated count is verified by cosine in double precision.

Calibration: two vectors just at the threshold share a cell with probability p ** cells, so ``orders``
takes as many orders as leave a share of at most MISS of such pairs without one (of pairs nearer than
that, far fewer); the windows and the count lose at most one in a million each. Cells grow with the
number of vectors, so a vector meets about as many others at any size.

Verified pairs only have to find the components. In the first round each vector proposes its best two
partners of an order; the second takes all pairs, but only between components that still differ, of
vectors that had more than two. Links are then counted exactly, block by block within each component:
neither the pairs of a group nor its vectors ever meet in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import connected_components
from quillon.llm.packing import pack, pack_by, unpack
from quillon.tables import materialize

COSINE = 0.95
#: Share of pairs at the threshold that no order shows; counted projections; most cells of an order, as bits.
MISS, COUNTED, MOST_BITS = 1e-5, 32, 24
#: Deviations, of a pair at the threshold, that a window reaches; steps of it in a stored projection.
WINDOW, STEPS = 5.0, 64
#: Rows of orders that a task sorts; rows of a cell compared in one task; vectors of a block.
PART, CELL, BLOCK = 200_000, 4096, 512
_ROWS = "kind int, a long, b long, part long, payload binary"
_PAIR, _MORE, _CELL = 0, 1, 2


def orders(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(bits of a cell, orders) for ``n`` vectors."""
    bits = max(1, min(MOST_BITS, int(math.log2(max(2, n))) - 5))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


def least_count(dims: int, cosine: float = COSINE) -> int:
    """Collisions, of min(dims, COUNTED), that all but a millionth of the pairs at ``cosine`` have. The
    windows reach two deviations of such a pair's differences, which are about normal; squares of all
    differences sum to 2 - 2 * cosine, so no pair misses more than dims / 4, which is sharper for short vectors."""
    m, p, below = min(dims, COUNTED), math.erf(2 / math.sqrt(2)), 0.0
    for c in range(m + 1):
        below += math.comb(m, c) * p**c * (1 - p) ** (m - c)
        if below > 1e-6:
            return max(c, m - dims // 4)
    return m


def _projector(bits: int, count: int) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    near = math.sqrt(2 - 2 * COSINE)

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, positions in the orders, codes) of unit vectors of one length."""
        n, dims = x.shape
        if dims not in made:
            rng = np.random.default_rng([41, dims])
            basis = np.linalg.qr(rng.standard_normal((dims, min(dims, COUNTED))))[0]
            made[dims] = rng.standard_normal((dims, count * bits)), rng.standard_normal((dims, count)), basis
        sides, lines, basis = made[dims]
        cell = ((x @ sides).reshape(n, count, bits) > 0) @ (1 << np.arange(bits))
        at = np.clip(np.floor((x @ lines + 16) * (STEPS / (WINDOW * near))), 0, 65535).astype(np.int64)
        code = np.zeros((n, COUNTED), np.uint8)
        # steps of an eighth of the window: neighbours differ by 9 at most, and values moved to the ends stay near
        code[:, : basis.shape[1]] = np.clip(np.floor(x @ basis * (8 * math.sqrt(dims) / (2 * near))) + 120, 10, 235)
        return cell, at, code

    return project


def _name_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, SHA-256 of the vector, its length, unit vector) of (vec_id, vector)."""
    for batch in batches:
        names, dims, units = [], [], []
        for v in batch.column(1):
            x = v.values.to_numpy()
            names.append(hashlib.sha256(x.tobytes()).digest())
            dims.append(len(x))
            units.append((x / np.linalg.norm(x)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "name", "dims", "unit"])


def _rows(kind: int, a=(), b=(), part=(), payload=()) -> pa.RecordBatch:
    n = max(len(a), len(part))
    cols = [pa.array([kind] * n, pa.int32()), *(pa.array(x if len(x) else [None] * n, pa.int64()) for x in (a, b, part)), pa.array(payload if len(payload) else [None] * n, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "a", "b", "part", "payload"])


def _place(bits: int, count: int, parts: int):
    """Each vector's rows in all orders, packed by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = _projector(bits, count)
        for batch in batches:
            node, dims, comp = (batch.column(c).to_numpy() for c in (0, 1, 3))
            for d in np.unique(dims).tolist():
                here = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(batch.column(2).take(pa.array(here)).to_pylist()), np.float64).reshape(-1, d)
                cell, at, code = project(x)
                key = ((np.int64(d) << 40) + (np.arange(count) << 32) + cell).ravel()
                part = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) * parts >> 24
                row = np.repeat(np.arange(len(here)), count)
                order = np.lexsort((key, part))
                words = np.ascontiguousarray(code).view(np.uint64)[row[order]]
                packed = list(pack_by(part[order], key[order], at.ravel()[order], node[here][row[order]], comp[here][row[order]], *words.T))
                yield _rows(_CELL, part=[p for p, _ in packed], payload=[raw for _, raw in packed])

    return run


class _Best:
    """The best two partners of each row, and how many it has."""

    def __init__(self, n: int) -> None:
        self.count, self.who, self.n = np.zeros((2, n), np.int64), np.full((2, n), -1, np.int64), np.zeros(n, np.int64)

    def add(self, rows: np.ndarray, partner: np.ndarray, count: np.ndarray) -> None:
        """``rows`` are distinct."""
        self.n[rows] += 1
        first = count > self.count[0, rows]
        second = ~first & (count > self.count[1, rows])
        up = rows[first]
        for kept in (self.count, self.who):
            kept[1, up] = kept[0, up]
        for row, pick in ((0, first), (1, second)):
            self.count[row, rows[pick]], self.who[row, rows[pick]] = count[pick], partner[pick]


def _collide(key: np.ndarray, at: np.ndarray, node: np.ndarray, comp: np.ndarray, code: np.ndarray, own: np.ndarray | None, all_pairs: bool) -> Iterator[pa.RecordBatch]:
    """Pairs whose windows collide often enough, of rows in the order of key and position. Only pairs of
    unequal ``own``, where given. With ``all_pairs``: every pair of unequal components; else the best
    two of each row, and the rows that have more."""
    best, need = _Best(len(key)), {}
    for d in np.unique(key >> 40).tolist():
        need[d] = least_count(d) + COUNTED - min(d, COUNTED)
    least = np.array([need[d] for d in (key >> 40).tolist()], np.int64)
    i, step = np.arange(len(key)), 0
    while True:
        step += 1
        i = i[i + step < len(key)]
        i = i[(key[i + step] == key[i]) & (at[i + step] - at[i] <= STEPS + 1)]
        if not len(i):
            break
        look = i
        if own is not None:
            look = look[own[look] != own[look + step]]
        if all_pairs:
            look = look[comp[look] != comp[look + step]]
        for lo in range(0, len(look), 1 << 16):
            x = look[lo : lo + (1 << 16)]
            y = x + step
            count = ((code[x] - code[y] + np.uint8(9)) <= 18).sum(axis=1)
            ok = count >= least[x]
            x, y, count = x[ok], y[ok], count[ok]
            if all_pairs and len(x):
                yield _rows(_PAIR, np.minimum(node[x], node[y]), np.maximum(node[x], node[y]))
            elif len(x):
                best.add(x, y, count)
                best.add(y, x, count)
    if not all_pairs:
        for who in best.who:
            x = np.flatnonzero(who >= 0)
            yield _rows(_PAIR, np.minimum(node[x], node[who[x]]), np.maximum(node[x], node[who[x]]))
        yield _rows(_MORE, np.unique(node[best.n > 2]))


def _open(payloads: list[bytes], columns: int) -> list[np.ndarray]:
    cols = [unpack(p, columns) for p in payloads]
    out = [np.concatenate([c[k] for c in cols]) for k in range(columns)]
    return [x.view(np.int64) for x in out[:4]] + out[4:]


def _cells(all_pairs: bool, seed: int = 0):
    """Sorts one part and compares its cells; those of over CELL rows leave in blocks, to meet pair by pair."""

    def run(t: pa.Table) -> pa.Table:
        key, at, node, comp, *words = _open(t.column("payload").to_pylist(), 8)
        order = np.lexsort((node, at, key))
        key, at, node, comp, *words = (x[order] for x in (key, at, node, comp, *words))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        out = []
        for lo, n in zip(first[size > CELL].tolist(), size[size > CELL].tolist(), strict=True):
            blocks = -(-n // CELL)
            cut = [slice(lo + n * b // blocks, lo + n * (b + 1) // blocks) for b in range(blocks)]
            for b in range(blocks):
                for c in range(b, blocks):
                    if at[cut[c]][0] - at[cut[b]][-1] > STEPS + 1:
                        break
                    name = int.from_bytes(hashlib.sha256(f"{key[lo]} {b} {c}".encode()).digest()[:7], "big")
                    for own, rows in {b: cut[b], c: cut[c]}.items():
                        raw = pack(key[rows], at[rows], node[rows], comp[rows], *(w[rows] for w in words), np.full(rows.stop - rows.start, own))
                        out.append(_rows(_CELL, part=[name], payload=[raw]))
        small = np.repeat(size <= CELL, size)
        code = np.stack(words, axis=1).view(np.uint8)
        out += _collide(key[small], at[small], node[small], comp[small], code[small], None, all_pairs)
        return pa.Table.from_batches(out)

    return run


def _blocks(all_pairs: bool):
    """Compares one pair of blocks of a cell, or a block with itself."""

    def run(t: pa.Table) -> pa.Table:
        key, at, node, comp, *words, own = _open(t.column("payload").to_pylist(), 9)
        order = np.lexsort((node, at, key))
        code = np.stack([w[order] for w in words], axis=1).view(np.uint8)
        own = own[order] if (own != own[0]).any() else None
        return pa.Table.from_batches(list(_collide(key[order], at[order], node[order], comp[order], code, own, all_pairs)) or [_rows(_PAIR)])

    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, unit of a, unit of b) at COSINE or more."""
    for batch in batches:
        ok = [bool(np.frombuffer(x.as_buffer()) @ np.frombuffer(y.as_buffer()) >= COSINE) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each vector with those of a pair of blocks of its component, from rows in the order of
    (root, dims, first block, second block, own block)."""
    held: pa.Table | None = None

    def count(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(t.column("unit").to_pylist())).reshape(len(t), -1)
        node, mult, own = (t.column(c).to_numpy() for c in ("node", "mult", "own"))
        links = np.zeros(len(t), np.int64)
        other = int(np.searchsorted(own, own[0], "right"))
        if t.column("lo")[0] == t.column("hi")[0]:
            for lo in range(0, len(t), BLOCK):
                near = x[lo : lo + BLOCK] @ x.T >= COSINE
                near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
                links[lo : lo + BLOCK] = near @ mult
        else:
            for lo in range(0, other, BLOCK):
                hi = min(other, lo + BLOCK)
                near = x[lo:hi] @ x[other:].T >= COSINE
                links[lo:hi] += near @ mult[other:]
                links[other:] += mult[lo:hi] @ near
        return node, links

    def work(t: pa.Table) -> pa.RecordBatch:
        group = np.stack([t.column(c).to_numpy() for c in ("root", "dims", "lo", "hi")])
        cut = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0), [True]])).tolist()
        found = [count(t.slice(a, b - a)) for a, b in zip(cut, cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["node", "links"])

    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        group = np.stack([t.column(c).to_numpy() for c in ("root", "dims", "lo", "hi")])
        start = np.flatnonzero((group != group[:, -1:]).any(axis=0))
        cut = int(start[-1]) + 1 if len(start) else 0
        if cut:
            yield work(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and len(held):
        yield work(held)


def worker_functions() -> list:
    """Everything of this module that tasks run."""
    return [_name_vectors, _place(3, 3, 3), _cells(False), _blocks(False), _linked, _count]


def _components(reps: DataFrame, same: DataFrame) -> DataFrame:
    """(id, root) of the nodes of ``reps(node, mult, dims, unit)`` that are linked, or joined by ``same(a, b)``."""
    n = reps.count()
    bits, count = orders(n)
    units = reps.select("node", "unit")
    links, live = same, None
    for all_pairs in (False, True):
        taken, comp = reps, F.col("node")
        if all_pairs:
            taken = reps.join(live, "node", "left_semi").join(connected_components(links).toDF("node", "root"), "node", "left")
            comp = F.coalesce("root", "node")
        placed = taken.select("node", "dims", "unit", comp.alias("comp")).mapInArrow(_place(bits, count, max(1, n * count // PART)), _ROWS)
        cells = materialize(placed.groupBy("part").applyInArrow(_cells(all_pairs), _ROWS), "projection-cells")
        wide = cells.where(F.col("kind") == _CELL).groupBy("part").applyInArrow(_blocks(all_pairs), _ROWS)
        found = cells.where(F.col("kind") != _CELL).unionByName(materialize(wide, "projection-blocks"))
        pairs = found.where(F.col("kind") == _PAIR).select("a", "b").distinct()
        both = pairs.join(units.toDF("a", "ua"), "a").join(units.toDF("b", "ub"), "b")
        links = links.union(materialize(both.select("a", "b", "ua", "ub").mapInArrow(_linked, "a long, b long"), "projection-links"))
        live = found.where(F.col("kind") == _MORE).select(F.col("a").alias("node")).distinct()
    return connected_components(links)


def _links(grouped: DataFrame) -> DataFrame:
    """(node, links) of ``grouped(node, mult, dims, unit, root, size)``: the vectors of other classes in
    the same component at COSINE or more. A component is cut into blocks of about BLOCK vectors by a
    hash; each vector goes to its block's meetings with every block."""
    blocks = F.ceil(F.col("size") / BLOCK)
    cut = grouped.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    sent = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.select("root", "dims", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "mult", "unit")
    met = sent.repartition("root", "dims", "lo", "hi").sortWithinPartitions("root", "dims", "lo", "hi", "own", "node")
    return met.mapInArrow(_count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``.

    Vectors link at cosine COSINE or more. Null, empty and zero vectors, and those with null or
    non-finite parts, link with nothing; vectors of different lengths do not link. Equal vectors, by
    their SHA-256, are one class and each counts as a link of the others. A null id keeps its row,
    without links, with a null component and kept true. Rows that share an id are vectors of their own,
    in one component. Other columns are ignored; an empty table gives an empty result.
    """
    v = F.col(vec_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, F.transform(v, lambda x: x + 0.0)).alias("v")).withColumn("norm", norm)
    good = F.coalesce((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False)) & F.col("vec_id").isNotNull()
    members = materialize(base.where(good).select("vec_id", "v").mapInArrow(_name_vectors, "vec_id long, name binary, dims int, unit binary"), "projection-vectors")
    reps = members.groupBy("name").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("dims").alias("dims"), F.first("unit").alias("unit"))
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "projection-classes")
    node = members.select("vec_id", "name").join(reps.select("name", "node"), "name").select("vec_id", "node").distinct()
    low = node.groupBy("vec_id").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    same = node.join(low, "vec_id").where("node != b").select(F.col("node").alias("a"), "b")
    roots = _components(reps, materialize(same, "projection-ids"))
    grouped = reps.join(roots.toDF("node", "root"), "node").select("node", "rep", "mult", "dims", "unit", "root")
    smallest = grouped.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("size"))
    grouped = materialize(grouped.join(smallest, "root"), "projection-components")
    of = reps.select("name", "node", "rep", "mult").join(grouped.select("node", "component"), "node", "left").join(_links(grouped), "node", "left")
    of = of.select("name", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    placed = members.select("vec_id", "name").join(of, "name").select("vec_id", "n_links", "component_id")
    alone = base.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND list_count(embedding) = len(embedding) AND isfinite(list_sum(embedding::DOUBLE[]))
    AND (list_max(embedding) > 0 OR list_min(embedding) < 0)
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.95
), reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT links.a, reached.other FROM reached JOIN links ON links.b = reached.vec_id
), component AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component USING (vec_id)
"""
