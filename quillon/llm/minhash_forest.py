"""MinHash near-dedup by an LSH forest.

Every distinct shingle set, named by a digest of all of it, gets a signature of ``TREES * DEPTH`` minima.
Each tree sorts its DEPTH minima, a byte of each, as a word; documents that share the longest prefixes in
some tree stand next to one another there and are candidates. The order is worked on by regions (documents
with one prefix of BASE minima). In a dense region neighbours share more, so a window of its order reaches
only the deeper prefixes; a region of more than REGION sets is also cut at these, so the depth adapts to the
density. Candidates whose signatures agree enough are compared on their
full shingle sets; only a confirmed pair is a link.

Links are verified in rounds. The first verifies a few best candidates of each set among NEAR neighbours
in each order, which already joins most groups; the following rounds take all sets of a region, but only
pairs whose components still differ, and the last verifies all of these. A pair inside one component is skipped because it cannot change the result.
The last round estimates by WIDE minima, signed only for the sets that it compares, so it proposes few
pairs that fail however many of a dense group are nearly similar enough.
A set whose regions all have at most NEAR + 1 sets has met them all in the first round and goes on only if a
pair passed. Shingle sets are built a round, for the pairs that it proposes.
A region that was cut is searched across its cuts too: every set outside the region's largest
component meets every other set of the region.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import connected_components
from quillon.llm.textkit import Shingler, slices
from quillon.tables import materialize, release

TREES, DEPTH, BASE, DEEPER = 16, 16, 4, 6
#: Rows of a region that are compared with one another; more are cut at DEEPER minima, then at all of them,
#: and what agrees in all of them by hash.
REGION, NEAR = 4096, 32
#: Subgroups of a group of equal sets; further sets of an id get numbers from here, above any id.
SALTS, FURTHER = 64, 2**62
#: The chance that a pair just at the similarity agrees in too few minima to be compared; a sure estimate.
MISS, EST_SURE = 1e-6, 0.93
_ROW = TREES * DEPTH
#: Minima of the signatures of the last round.
WIDE = 1024

_SIG = "doc_id long, n_shingles long, name binary, sig binary, k4 array<long>"


def ratio_of(similarity: float) -> tuple[int, int]:
    """``similarity`` as it is written in decimals, as a fraction of whole numbers."""
    return Fraction(str(similarity)).as_integer_ratio()


def least_estimate(similarity: float, minima: int = _ROW) -> float:
    """The estimate below which pairs are not compared. Of pairs at ``similarity`` a share of at most MISS
    has less: the bytes of their minima agree independently, by chance in one of 256 where the minima differ."""
    p, below = similarity + (1 - similarity) / 256, 0.0
    for m in range(minima + 1):
        below += math.comb(minima, m) * p**m * (1 - p) ** (minima - m)
        if below > MISS:
            return (m / minima * 256 - 1) / 255
    return 1.0


def tree_recall(similarity: float) -> float:
    """The chance that two sets at ``similarity`` share a region in some tree."""
    return 1 - (1 - similarity**BASE) ** TREES


def _signer():
    rng = np.random.default_rng(2024)
    mul = rng.integers(0, 2**31, (TREES * DEPTH, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, (TREES * DEPTH, 1), dtype=np.uint32)
    fold = rng.integers(1, 2**63, BASE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    tree = np.arange(TREES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def sign(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (sets >> np.uint64(32)).astype(np.uint32)
        low = np.full(TREES * DEPTH, 2**32 - 1, np.uint32)
        for i in range(0, len(x), 4096):
            np.minimum(low, (x[None, i : i + 4096] * mul + add).min(axis=1), out=low)
        k = (low.reshape(TREES, DEPTH)[:, :BASE].astype(np.uint64) * fold).sum(axis=1, dtype=np.uint64) + tree
        k ^= k >> np.uint64(29)
        keys = (k * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
        return (low * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8), keys

    return sign


def _wide_signer():
    rng = np.random.default_rng(2025)
    mul = rng.integers(0, 2**31, (WIDE, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, (WIDE, 1), dtype=np.uint32)

    def sign(sets: np.ndarray) -> bytes:
        x, low = (sets >> np.uint64(32)).astype(np.uint32), np.full(WIDE, 2**32 - 1, np.uint32)
        for i in range(0, len(x), 1024):
            np.minimum(low, (x[None, i : i + 1024] * mul + add).min(axis=1), out=low)
        return (low * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()

    return sign


def _sets(sh: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        x = np.sort(sh[a:b])
        yield x[np.concatenate([[True], x[1:] != x[:-1]])] if b - a > 1 else x


def _name(x: np.ndarray) -> bytes:
    """A set's digest: equal names are equal sets."""
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: set size, the set's name, its minima, and the forest's regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sign = Shingler(), _signer()
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1)):
                cols: list[list] = [[] for _ in range(4)]
                for x in _sets(*shingle(data, off)):
                    s, keys = sign(x) if len(x) else (None, None)
                    for c, value in zip(cols, (len(x), _name(x), None if s is None else s.tobytes(), keys), strict=True):
                        c.append(value)
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_shingles", "name", "sig", "k4"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _SIG)


def _pairs_in(mat: np.ndarray, size: np.ndarray, key_end: np.ndarray, comp: np.ndarray | None, trees: np.ndarray, own: np.ndarray, similarity: float, least: float):
    """Passing pairs (i, j, estimate) of rows within one key; key_end[i]: row after the last of i's key.
    Without ``comp`` only NEAR neighbours, and the first row of the key, are compared. With it, a pair
    that shares regions of several trees counts in the first of these only; ``trees`` holds the regions
    of each row and ``own`` the one at hand."""
    n, out = len(mat), []
    (num, den), at_once = ratio_of(similarity), 50_000 * _ROW // mat.shape[1]
    length = key_end - np.arange(n)
    widest = int(length.max(initial=0))

    def keep(i, j):
        a, b = size[i], size[j]
        ok = den * np.minimum(a, b) >= num * np.maximum(a, b)
        if comp is not None:
            ok &= comp[i] != comp[j]
        i, j = i[ok], j[ok]
        if comp is not None and len(i):
            ok = trees[i, (trees[i] == trees[j]).argmax(axis=1)] == own[i]
            i, j = i[ok], j[ok]
        if not len(i):
            return
        est = ((mat[i] == mat[j]).sum(axis=1) / mat.shape[1] * 256 - 1) / 255
        ok = est >= least - 1e-9
        out.append((i[ok], j[ok], est[ok]))

    if comp is None and widest > NEAR:
        first = np.flatnonzero(np.concatenate([[True], key_end[1:] != key_end[:-1]]))
        head = np.repeat(first, np.diff(np.append(first, n)))
        far = np.flatnonzero(np.arange(n) - head > NEAR)
        for at in range(0, len(far), 50_000):
            keep(head[far[at : at + 50_000]], far[at : at + 50_000])
        widest = NEAR + 1
    for step in range(1, widest):
        i = np.flatnonzero(length > step)
        for at in range(0, len(i), at_once):
            keep(i[at : at + at_once], i[at : at + at_once] + step)
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]


def _thin(i: np.ndarray, j: np.ndarray, est: np.ndarray, most: int | None, ids: np.ndarray):
    """A few pairs of each row: the smallest id that is nearly certain, or else its best. Which one is
    smallest does not depend on the order, so the trees of a dense group propose much the same pairs."""
    if most is None or not len(i):
        return i, j
    a, b, e = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([est, est])
    sure = np.flatnonzero((e >= EST_SURE) & (ids[b] < ids[a]))
    sure = sure[np.lexsort((ids[b[sure]], a[sure]))]
    sure = sure[np.concatenate([[True], a[sure][1:] != a[sure][:-1]])] if len(sure) else sure
    rest = np.ones(len(ids), bool)
    rest[a[sure]] = False
    order = np.flatnonzero(rest[a])
    order = order[np.lexsort((ids[b[order]], -e[order], a[order]))]
    rank = np.zeros(0, np.int64)
    if len(order):
        first = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1]]))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    pick = np.concatenate([order[rank < most], sure])
    both = np.unique(np.stack([np.minimum(a[pick], b[pick]), np.maximum(a[pick], b[pick])]), axis=1)
    return both[0], both[1]


def _candidates(entries: DataFrame, most: int | None, use_comp: bool, similarity: float, minima: int = _ROW) -> DataFrame:
    """Distinct pairs (a, b) of ids that share a region, from ``entries(key, id, n, sig, comp)``."""
    least = least_estimate(similarity, minima)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def work(t: pa.Table) -> pa.RecordBatch:
            key, ids, size = (t.column(c).to_numpy() for c in ("key", "id", "n"))
            mat = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, minima)
            last = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1
            end = last[np.searchsorted(last, np.arange(len(key)), "right")]
            comp = t.column("comp").to_numpy() if use_comp else None
            trees = t.column("trees").combine_chunks().flatten().to_numpy().reshape(-1, TREES)
            i, j = _thin(*_pairs_in(mat, size, end, comp, trees, t.column("k4").to_numpy(), similarity, least), most, ids)
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield work(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and len(held):
            yield work(held)

    rows = entries.select("key", "k4", "prefix", "id", "n", "sig", "comp", "trees").repartition("key").sortWithinPartitions("key", "prefix", "id")
    return rows.mapInArrow(run, "a long, b long").where("a != b").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose full sets have intersection >= similarity * union."""
    num, den = ratio_of(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                z = np.sort(np.concatenate([u, v]))
                both = int((z[1:] == z[:-1]).sum())
                ok.append(den * both >= num * (len(z) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    one = pairs.join(sets.toDF("a", "sa"), "a")
    return one.join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _shingle_sets(docs: DataFrame, wide: bool = False) -> DataFrame:
    """(id, set) of the rows of ``docs(id, name, text)`` whose set has the name; ``wide``: its wide signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sign = Shingler(), _wide_signer() if wide else np.ndarray.tobytes
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(2)):
                found = list(_sets(*shingle(data, off)))
                ok = pa.array([_name(x) == name for x, name in zip(found, batch.column(1).slice(lo, hi - lo).to_pylist(), strict=True)], pa.bool_())
                packed = pa.array([sign(x) for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).filter(ok), packed.filter(ok)], names=["id", "set"])

    return docs.mapInArrow(run, "id long, set binary")


def _copies(named: DataFrame) -> DataFrame:
    """Edges (a, b) from nodes of ``named(node, name)`` to smaller ones of the same name. A group is first
    joined within SALTS parts of it, so that no task meets all of a large one."""
    part = named.select("name", "node", F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    subs = part.groupBy("name", "salt").agg(F.min("node").alias("sub"), F.count("*").alias("n"))
    heads = subs.groupBy("name").agg(F.min("sub").alias("head"), F.sum("n").alias("n")).where("n > 1").select("name", "head")
    met = materialize(subs.join(heads, "name").select("name", "salt", "sub", "head"), "forest-heads")
    inner = part.join(met, ["name", "salt"]).select(F.col("node").alias("a"), F.col("sub").alias("b"))
    return inner.union(met.select(F.col("sub").alias("a"), F.col("head").alias("b"))).where("a != b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; a set holds the distinct 5-word
    shingles, or the whole sequence of a shorter text. Sets link at Jaccard similarity ``similarity`` or more.
    Null or empty text has an empty set and links with nothing. A null id keeps its row, with its own
    null component and kept true. An id on several rows stands for all of them: a link of any set counts,
    and each of its rows has the same component. Equal sets are those of one 128-bit digest of all shingles. Ties go to the smaller id. Other columns are ignored,
    so their names cannot clash; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = materialize(signatures(base).withColumn("row", F.monotonically_increasing_id()), "forest-signatures")
    named = sigs.where("doc_id is not null and n_shingles > 0")
    again = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    several = not again.isEmpty()
    if several:  # a node for each set of an id, the first of them under the id itself
        low = named.join(again, "doc_id").groupBy("doc_id").agg(F.min("name").alias("low"))
        named = named.join(low, "doc_id", "left")
        named = materialize(named.withColumn("node", F.when(F.coalesce(F.col("name") != F.col("low"), F.lit(False)), F.col("row") + FURTHER).otherwise(F.col("doc_id"))), "forest-nodes")
    else:
        named = named.withColumn("node", F.col("doc_id"))
    copies = _copies(named).union(named.where(F.col("node") != F.col("doc_id")).select(F.col("node").alias("a"), F.col("doc_id").alias("b")))
    copies = materialize(copies.distinct(), "forest-copies")
    first = named.join(copies.select(F.col("a").alias("node")).where(F.col("node") < FURTHER), "node", "left_anti")

    trees = first.select(F.col("node").alias("id"), "sig", F.posexplode("k4").alias("tree", "k4"))
    trees = trees.select("id", "k4", F.substring("sig", F.col("tree") * DEPTH + 1, F.lit(DEPTH)).alias("prefix"))
    shared = trees.groupBy("k4").agg(F.count("*").alias("c4")).where("c4 > 1")
    entries = materialize(trees.join(shared, "k4"), "forest-entries")
    big = entries.where(F.col("c4") > REGION)
    cut = any(True for _ in big.select("k4").limit(1).toLocalIterator())
    entries = entries.where(F.col("c4") <= REGION).select(F.col("k4").alias("key"), "k4", "prefix", "id", F.lit(False).alias("cut"), (F.col("c4") > NEAR + 1).alias("wide"))
    if cut:
        big = big.withColumn("some", F.substring("prefix", 1, DEEPER))
        some = big.groupBy("k4", "some").agg(F.count("*").alias("c_some"))
        all_ = big.groupBy("k4", "prefix").agg(F.count("*").alias("c_all"))
        parts = F.ceil(F.col("c_all") / REGION)
        key = F.when(F.col("c_some") <= REGION, F.xxhash64("k4", "some")).otherwise(F.xxhash64("k4", "prefix", F.pmod(F.xxhash64("id"), parts)))
        split = big.join(some, ["k4", "some"]).join(all_, ["k4", "prefix"]).select(key.alias("key"), "k4", "prefix", "id", F.lit(True).alias("cut"), F.lit(True).alias("wide"))
        head = big.groupBy("k4").agg(F.min(F.struct("id", "prefix")).alias("h"))
        heads = split.select("key", "k4").distinct().join(head, "k4").select("key", "k4", "h.prefix", "h.id", F.lit(True).alias("cut"), F.lit(True).alias("wide"))
        entries = entries.unionByName(split).unionByName(heads)
    facts = first.select(F.col("node").alias("id"), F.col("n_shingles").alias("n"), "sig", F.col("k4").alias("trees")).dropDuplicates(["id"])
    entries = materialize(entries.distinct().join(facts, "id"), "forest-regions")
    pairs = materialize(_candidates(entries.withColumn("comp", F.lit(0).cast("long")), 2, False, similarity), "forest-pairs")
    live = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    live = materialize(live.union(entries.where("wide").select("id")).distinct(), "forest-live")
    release(spark)
    holders = first.select(F.col("node").alias("id"), "doc_id", "name")

    def of_texts(needed: DataFrame, wide: bool) -> DataFrame:
        texts = base.join(holders.join(needed, "id"), "doc_id").select("id", "name", "text")
        sets = _shingle_sets(texts, wide)
        sets = materialize(sets.dropDuplicates(["id"]) if several else sets, "forest-sets")
        release(spark)
        return sets

    def verified(proposed: DataFrame) -> DataFrame:
        sets = of_texts(proposed.select(F.col("a").alias("id")).union(proposed.select(F.col("b").alias("id"))).distinct(), False)
        return _verify(proposed, sets, similarity)

    links = materialize(verified(pairs), "forest-links")
    release(spark)
    seen = pairs
    entries = entries.join(live, "id", "left_semi")
    for most in (4, None):
        roots = connected_components(links)
        placed = entries.join(roots, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
        mixed = placed.groupBy("k4").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("k4")
        placed = placed.join(mixed, "k4")
        if cut:
            placed = materialize(placed, "forest-mixed")
            wide = placed.where("cut")
            main = wide.groupBy("k4", "comp").agg(F.count_distinct("id").alias("c")).groupBy("k4").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
            minor = wide.join(main, "k4").where("comp != main").select("k4", "prefix", "id", "cut", "wide", "n", "sig", "comp", "trees").distinct()
            keys = wide.select("key", "k4").distinct()
            placed = placed.unionByName(keys.join(minor, "k4").select(*placed.columns)).distinct()
        minima = _ROW
        if most is None:
            placed = materialize(placed, "forest-last")
            placed, minima = placed.drop("sig").join(of_texts(placed.select("id").distinct(), True).toDF("id", "sig"), "id"), WIDE
        more = _candidates(placed, most, True, similarity, minima).join(seen, ["a", "b"], "left_anti")
        more = materialize(more, "forest-pairs")
        if more.isEmpty():
            continue
        links = materialize(links.union(verified(more)), "forest-links")
        seen = seen.union(more)
        release(spark)
    roots = connected_components(links.union(copies))
    out = sigs.select("doc_id", "n_shingles").join(roots.toDF("doc_id", "component_id"), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, similarity: float = 0.85) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns kept. Of several rows with
    one doc_id, one stays; rows without a doc_id stay."""
    found = materialize(near_duplicates(docs, similarity=similarity), "forest-found")
    gone = found.where("not kept").select("doc_id").distinct()
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = docs.join(twice.join(gone, "doc_id", "left_anti"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rest = docs.join(gone.union(twice).distinct(), "doc_id", "left_anti")
    return rest.unionByName(again.select(*rest.columns)).select(*docs.columns)
