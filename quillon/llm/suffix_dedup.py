"""Repeated-substring removal by blockwise suffix sorting over a difference cover.

Only suffixes that start at cover positions (offsets of a document that are, modulo PERIOD, in a
perfect difference set) are sorted. For any two positions i and j there is a shift below PERIOD that
takes both to cover positions, so two equal strings of LENGTH bytes always hold two equal cover
samples of SAMPLE bytes in step. The order of samples by a hash of their first SAMPLE bytes is cut
into buckets; one bucket at a time is sorted, which bounds memory. Ties, samples with equal SAMPLE
bytes, are ranked by the hash of all text that a repeat through them could cover:

* equal ranks: every string of LENGTH bytes through the sample is repeated;
* equal samples of unequal rank: the repeat ends nearby. Those few strings are hashed byte by byte,
  and sorted bucket by bucket in the same way.

The same is done over words: a document shares a passage if PASSAGE words in a row, ASCII case and white
space aside, also stand in another document. Only documents are marked then, and nothing is removed.

Ranks are hashes of 112 bits over pairs of bytes, not the bytes: order between unequal strings is not
needed. Everything that travels is packed, column by column, into one binary value per bucket and batch, with
repeats inside the batch already settled, so a passage of a third of all documents sends one sample
per batch; so does a short one in many surroundings, whose samples the batch sends to be probed itself.
Documents meet their marks in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.packing import pack_by, unpack
from quillon.llm.textkit import PairRolling, Rolling, WordHashes, mix, slices
from quillon.tables import materialize, release

#: Bytes of a repeated string that is removed; words of a passage that documents share.
LENGTH, PASSAGE = 400, 51
#: Samples that are settled together before they are sent; text bytes of a block; samples of a bucket.
BATCH, BLOCK_BYTES, BUCKET = 500_000, 8 << 20, 500_000
#: Surroundings of one sample in a batch from which it is probed without asking other batches.
HOT = 16
_U = np.uint64


class Unit(NamedTuple):
    """Strings of ``length`` bytes or words, sampled at the positions ``cover`` modulo ``period``; the
    kinds of its marks: all strings through a sample repeat, a sample to probe, a repeated string.
    ``across``: repeats count only between documents."""

    length: int
    period: int
    cover: tuple[int, ...]
    full: int
    probe: int
    string: int
    across: bool

    @property
    def sample(self) -> int:
        return self.length - self.period + 1


def difference_cover(q: int) -> tuple[int, ...]:
    """Singer's perfect difference set modulo q*q + q + 1, for a prime q: the exponents i for which
    the i-th power of a root of a cubic over GF(q) has no quadratic term."""
    v = q * q + q + 1
    for c in range(1, q):
        for b in range(q):
            for a in range(q):
                x, found = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        found.append(i)
                    top = x[2]
                    x = (top * c % q, (x[0] + top * b) % q, (x[1] + top * a) % q)
                if len(found) == q + 1 and len({(s - t) % v for s in found for t in found}) == v:
                    return tuple(found)
    raise ValueError("q must be prime")


def units() -> tuple[Unit, Unit]:
    """Bytes by a cover of 14 positions in 183, words by one of 6 in 31."""
    return Unit(LENGTH, 183, difference_cover(13), 1, 2, 3, False), Unit(PASSAGE, 31, difference_cover(5), 4, 5, 6, True)


def _marks(kind: int, doc: np.ndarray, pos: np.ndarray, blocks: int) -> Iterator[tuple[int, int, bytes]]:
    block = doc.astype(np.int64) % blocks
    order = np.lexsort((pos, doc, block))
    for b, raw in pack_by(block[order], doc[order], pos[order]):
        yield b, kind, raw


def _classes(key: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first row of each class of equal key and ctx, class of each row) in sorted order."""
    order = np.lexsort((ctx, key))
    k, c = key[order], ctx[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


class _Sender:
    """Gathers samples or strings of one kind, settles repeats within a batch, and packs the rest by bucket."""

    def __init__(self, unit: Unit, kind: int, buckets: int, blocks: int) -> None:
        self.unit, self.kind, self.buckets, self.blocks, self.held, self.n = unit, kind, buckets, blocks, [], 0

    def add(self, key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Iterator[tuple]:
        self.held.append((key, ctx & _U(2**48 - 1), doc, pos))
        self.n += len(key)
        if self.n >= BATCH:
            yield from self.flush()

    def marks(self, kind: int, doc: np.ndarray, pos: np.ndarray) -> Iterator[tuple]:
        for block, kind, raw in _marks(kind, doc, pos, self.blocks):
            yield -1 - block, kind, raw

    def flush(self) -> Iterator[tuple]:
        if not self.n:
            return
        key, ctx, doc, pos = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        order, first, of = _classes(key, ctx)
        if self.unit.across:
            low, high = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
            many = low != high
        else:
            many = np.diff(np.append(first, len(key))) > 1
        again = order[many[of]]
        if self.unit.across:
            again = again[np.unique(doc[again], return_index=True)[1]]
        yield from self.marks(self.kind, doc[again], pos[again])
        one = order[first]
        if self.kind == self.unit.full:
            head = np.flatnonzero(np.concatenate([[True], key[one][1:] != key[one][:-1]]))
            size = np.diff(np.append(head, len(one)))
            hot = np.repeat(size >= HOT, size)
            yield from self.marks(self.unit.probe, doc[one[hot]], pos[one[hot]])
            hot[head] = False
            one, many = one[~hot], many[~hot]
        key, ctx, doc = key[one], ctx[one], doc[one]
        where = pos[one].astype(_U) * _U(2) + many.astype(_U)
        bucket = ((key >> _U(40)) * _U(self.buckets) >> _U(24)).astype(np.int64)
        step = np.diff(key, prepend=_U(0))
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        step[cut] = key[cut]
        for b, raw in pack_by(bucket, step, ctx, doc, where):
            yield 2 * b + self.unit.across, self.kind, raw


_ROWS = "part long, kind int, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    part, kind, raw = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(raw, pa.binary())], names=["part", "kind", "payload"])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)])


def _settle(blocks: int) -> Callable[[pa.Table], pa.Table]:
    """Sorts one bucket: marks of repeated classes, and probes where equal keys have unequal ranks."""
    probes = {u.full: u.probe for u in units()}

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        raw = t.column("payload").to_pylist()
        if part < 0:  # marks that a batch had settled
            return _table([(-1 - part, k, r) for k, r in zip(t.column("kind").to_pylist(), raw, strict=True)])
        kind = t.column("kind")[0].as_py()
        cols = [unpack(r, 4) for r in raw]
        key = np.concatenate([np.cumsum(c[0], dtype=_U) for c in cols])
        ctx, doc, where = (np.concatenate([c[i] for c in cols]) for i in (1, 2, 3))
        doc, pos, many = doc.view(np.int64), (where >> _U(1)).astype(np.int64), (where & _U(1)).astype(bool)
        order, first, of = _classes(key, ctx)
        repeated = np.diff(np.append(first, len(key))) > 1
        full = order[repeated[of] & ~many[order]]
        out = list(_marks(kind, doc[full], pos[full], blocks))
        if kind in probes:
            head = key[order[first]]
            other = np.zeros(len(first), bool)
            other[1:] |= head[1:] == head[:-1]
            other[:-1] |= head[1:] == head[:-1]
            probe = order[first[other]]
            out += _marks(probes[kind], doc[probe], pos[probe], blocks)
        return _table(out)

    return run


class _Cover:
    """The samples of a unit in a sequence of documents, hashed."""

    def __init__(self, unit: Unit) -> None:
        self.unit, self.base = unit, np.array(unit.cover, np.int64)
        self.at = self.base

    def __call__(self, size: np.ndarray, off: np.ndarray, one: Rolling, two: Rolling, h: np.ndarray, g: np.ndarray):
        """(document, position, key, context) of each sample; one, two: the hashes that h and g sum."""
        u, most = self.unit, int(size.max(initial=0))
        if self.at[-1] < most:
            self.at = (np.arange(most // u.period + 2)[:, None] * u.period + self.base[None, :]).ravel()
        n = np.where(size >= u.length, np.searchsorted(self.at, size - u.sample, "right"), 0)
        doc = np.repeat(np.arange(len(size)), n)
        p = self.at[np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)]
        start, end = np.maximum(0, p - u.period + 1), np.minimum(size[doc], p + u.sample + u.period - 1)
        o = off[doc]
        key = mix(one.ranges(h, o + p, o + p + u.sample))
        ctx = mix(two.ranges(g, o + start, o + end) + (p - start).astype(_U) * _U(0x9E3779B97F4A7C15))
        return doc, p, key, ctx


def _sample(buckets: int, blocks: int):
    both = units()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, words, first, second = PairRolling(3), PairRolling(5), WordHashes(7), Rolling(9), Rolling(13)
        covers = [_Cover(u) for u in both]
        sends = [_Sender(u, u.full, buckets, blocks) for u in both]
        for batch in batches:
            key_col = batch.column(0).to_numpy()
            out = []
            for lo, hi, data, off in slices(batch.column(1)):
                if int(np.diff(off).max(initial=0)) >= LENGTH:
                    doc, p, key, ctx = covers[0](np.diff(off), off[:-1], one, two, one.prefix(data), two.prefix(data))
                    out += sends[0].add(key, ctx, key_col[lo:hi][doc], p)
                word, at = words(data, off)
                doc, p, key, ctx = covers[1](np.diff(at), at[:-1], first, second, first.sums(word), second.sums(word))
                out += sends[1].add(key, ctx, key_col[lo:hi][doc], p)
            if out:
                yield _rows(out)
        yield _rows([x for send in sends for x in send.flush()])

    return run


def _spread(marks: list[tuple[int, bytes]]) -> dict[int, list[tuple[int, np.ndarray]]]:
    """Marks of a block by document: (kind, positions)."""
    found: dict[int, list] = {}
    for kind, raw in marks:
        doc, pos = unpack(raw, 2)
        doc, pos = doc.view(np.int64), pos.view(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])).tolist()
        for a, b in zip(cut, [*cut[1:], len(doc)], strict=True):
            found.setdefault(int(doc[a]), []).append((kind, pos[a:b]))
    return found


def _covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    ok = end > start
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, start[ok], 1)
    np.add.at(step, end[ok], -1)
    return np.cumsum(step[:-1]) > 0


def _strings(buckets: int, blocks: int):
    """Hashes of the strings around probes, document by document of a block."""
    both = units()

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if not len(docs) or not len(marks):
            return _table([])
        sends = [_Sender(u, u.string, buckets, blocks) for u in both]
        one, two, words, first, second = PairRolling(17), PairRolling(19), WordHashes(7), Rolling(21), Rolling(23)
        found = _spread(list(zip(marks.column("kind").to_pylist(), marks.column("payload").to_pylist(), strict=True)))
        keys = docs.column("key").to_pylist()
        for lo, _, data, off in slices(docs.column("text")):
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                for u, send, x, y in ((both[0], sends[0], one, two), (both[1], sends[1], first, second)):
                    p = [pos for kind, pos in found.get(keys[lo + i], ()) if kind == u.probe]
                    if not p:
                        continue
                    if u.across:
                        word, _ = words(data[a:b], np.array([0, b - a]))
                        size, h, g = len(word), x.sums(word), y.sums(word)
                    else:
                        size, h, g = b - a, x.prefix(data[a:b]), y.prefix(data[a:b])
                    p, n = np.concatenate(p), size - u.length + 1
                    start = np.flatnonzero(_covered(n, np.minimum(n, np.maximum(0, p - u.period + 1)), np.minimum(n, p + 1)))
                    end = start + u.length
                    out += send.add(mix(x.ranges(h, start, end)), mix(y.ranges(g, start, end)), np.full(len(start), keys[lo + i], np.int64), start)
        return _table(out + [x for send in sends for x in send.flush()])

    return run


def _finish():
    byte, word = units()
    kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage"]

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        found = _spread(list(zip(marks.column("kind").to_pylist(), marks.column("payload").to_pylist(), strict=True))) if len(marks) else {}
        keys = docs.column("key").to_pylist() if len(docs) else []
        cols: list[list] = [[] for _ in kinds]
        ids = docs.column("doc_id").to_pylist() if len(docs) else []
        none = np.zeros(0, np.int64)
        for lo, _, data, off in slices(docs.column("text")) if len(docs) else ():
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                size, text, hits = b - a, data[a:b], found.get(keys[lo + i], ())
                p = np.concatenate([none, *(x for kind, x in hits if kind == byte.full)])
                q = np.concatenate([none, *(x for kind, x in hits if kind == byte.string)])
                gone = np.zeros(size, bool)
                if len(p) or len(q):
                    start = np.concatenate([np.maximum(0, p - byte.period + 1), q])
                    gone = _covered(size, start, np.concatenate([np.minimum(size, p + byte.sample + byte.period - 1), q + byte.length]))
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                shares = any(kind in (word.full, word.string) for kind, _ in hits)
                row = (ids[lo + i], size, int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest(), shares)
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


def _prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage): one row per row of ``docs``.

    A UTF-8 byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in this or
    another document; the input decides, not what is left of it. Null or empty text is zero bytes.
    ``shares_passage``: PASSAGE words in a row of the text, with A-Z in lower case, also stand in a row
    in another document. Rows with null or repeated ids are documents of their own; then rows are named
    by a hash of id and text, and rows equal in both repeat one another. Other columns are ignored; an
    empty table gives an empty result. A text is never cut; one document is worked on at a time.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    odd = base.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null or doc_id < 0")
    named = base.withColumn("key", F.col("doc_id") if odd.isEmpty() else F.xxhash64("doc_id", F.hash("text"), "text", F.octet_length("text")).bitwiseAND(F.lit(2**63 - 1)))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = _prime(max(3, size // BLOCK_BYTES))
    buckets = max(3, size * 14 // 183 // BUCKET)
    long = named.where(F.octet_length("text") >= 2 * PASSAGE - 1)
    samples = long.select("key", "text").mapInArrow(_sample(buckets, blocks), _ROWS)
    marks = materialize(samples.groupBy("part").applyInArrow(_settle(blocks), _ROWS), "suffix-marks")
    release(spark)
    placed = named.withColumn("part", F.pmod("key", F.lit(blocks)))
    probe, known = [u.probe for u in units()], [u.full for u in units()]
    near = long.withColumn("part", F.pmod("key", F.lit(blocks))).select("part", "key", "text").groupBy("part").cogroup(marks.where(F.col("kind").isin(probe)).groupBy("part"))
    strings = near.applyInArrow(_strings(buckets, blocks), _ROWS).groupBy("part").applyInArrow(_settle(blocks), _ROWS)
    strings = materialize(strings, "suffix-strings")
    release(spark)
    known = marks.where(F.col("kind").isin(known)).union(strings)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage boolean"
    return placed.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_finish(), out)
