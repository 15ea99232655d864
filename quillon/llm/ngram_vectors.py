"""Hashed n-gram counts of whole texts as TF-IDF vectors, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.textkit import Rolling, slices, words


#: Counts of more labels than this are joined by a shuffle.
BROADCAST_LABELS = 10_000

#: Measures of style, steps of each, places that a step fills, and the count it has there.
MEASURES, STEPS, PLACES, STYLE_COUNT = 5, 10, 16, 20


class NgramCounter:
    """Counts of hashed byte n-grams of one text, by their UTF-8 bytes.

    With ``letters`` only letters count, in lower case, and all else is one space between words. Without,
    digits count as 0 and white space as a space, and the style of the text follows the n-grams: the
    shares of words that repeat the last one and of distinct words, of signs and capitals among bytes,
    and the mean length of words, each as a step that fills PLACES dimensions."""

    def __init__(self, sizes: tuple[int, ...], dims: int, letters: bool) -> None:
        self.sizes, self.dims, self.shift, self.letters = sizes, dims, np.uint32(32 - (dims.bit_length() - 1)), letters
        self.size = dims if letters else dims + MEASURES * STEPS * PLACES
        self.map = np.arange(256, dtype=np.uint32)
        self.map[[0x20, *range(0x09, 0x0E)]] = 0x20
        if letters:
            self.map[[i for i in range(128) if not chr(i).isalpha()]] = 0x20
            self.map[65:91] += 32
        else:
            self.map[48:58] = 48
            self.rolling = Rolling(23)

    def _plain(self, text: np.ndarray) -> np.ndarray:
        """Letters in lower case, those of Latin-1 too, with single spaces."""
        x = self.map[text]
        capital = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)) + 1
        x[capital] += 0x20
        gap = x == 0x20
        keep = np.ones(len(x), bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        return x[keep]

    def _style(self, text: np.ndarray) -> np.ndarray:
        start, end, _ = words(text, np.array([0, len(text)]))
        if not len(start):
            return np.zeros(0, np.int64)
        h = self.rolling.ranges(self.rolling.prefix(text), start, end)
        n = len(h)
        sign = ((text < 48) & (text > 32)) | ((text > 57) & (text < 65)) | ((text > 90) & (text < 97)) | ((text > 122) & (text < 127))
        shares = (
            (h[1:] == h[:-1]).sum() / n * 4, len(np.unique(h)) / n, sign.mean() * 6, ((text > 64) & (text < 91)).mean() * 3, (end - start).mean() / 20,
        )
        return np.array([k * STEPS + min(STEPS - 1, int(s * (STEPS - 1) + 0.9)) for k, s in enumerate(shares)])

    def __call__(self, text: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dims, np.int64)
        for at in range(0, max(1, len(text)), 1 << 20):  # a very long text in pieces that overlap
            piece = text[at : at + (1 << 20) + max(self.sizes) - 1]
            x = self._plain(piece) if self.letters else self.map[piece]
            code = np.zeros(len(x), np.uint32)
            for n in range(1, max(self.sizes) + 1):
                if len(x) < n:
                    break
                code = code[: len(x) - n + 1] * np.uint32(257) + x[n - 1 :]
                if n in self.sizes:
                    hashed = (code + np.uint32(n * 0x1F123BB5)) * np.uint32(0x9E3779B1)
                    hashed ^= hashed >> np.uint32(15)
                    hashed *= np.uint32(0x85EBCA77)
                    total += np.bincount((hashed >> self.shift)[: 1 << 20], minlength=self.dims)
        if self.letters:
            return total
        style = np.zeros((MEASURES * STEPS, PLACES), np.int64)
        style[self._style(text)] = STYLE_COUNT
        return np.concatenate([total, style.ravel()])


def unit_rows(x: np.ndarray) -> np.ndarray:
    """``x`` with rows of length 1, in place; empty rows stay empty."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    x /= np.where(norm > 0, norm, 1)
    return x


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors: (1 + ln count) * idf."""
    x = counts.astype(np.float32)
    np.log(x, out=x, where=x > 0)
    x += counts > 0
    x *= idf
    return unit_rows(x)


def inverse_frequency(counts: np.ndarray) -> np.ndarray:
    return (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.1).astype(np.float32)


def count_vectors(docs: DataFrame, counter: NgramCounter, label_type: str) -> DataFrame:
    """(label, counts) of ``docs(text, label)``, counts as packed 16-bit integers, 65,535 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(0)):
                packed = [np.minimum(counter(data[a:b]), 65535).astype(np.uint16).tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["label", "counts"])

    return docs.select("text", "label").mapInArrow(run, f"label {label_type}, counts binary")


def collect_vectors(vectors: DataFrame) -> tuple[list, np.ndarray]:
    """(labels, counts) of a bounded sample, in an order that does not depend on its partitions."""
    rows = sorted(((r["label"], bytes(r["counts"])) for r in vectors.collect()))
    return [x for x, _ in rows], np.stack([np.frombuffer(c, np.uint16) for _, c in rows]) if rows else np.zeros((0, 0), np.uint16)


def bounded_sample(rows: DataFrame, label: str, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` rows of each label: those with the smallest hash of ``key``. A label's share of
    hashes is set from its count first, so that no label's rows are ever gathered to be ordered."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30))
    n = rows.groupBy(label).agg(F.count("*").alias("__n")).where(F.col(label).isNotNull())
    counted = n.collect()  # one row for each label
    n = rows.sparkSession.createDataFrame(counted, n.schema)
    n = F.broadcast(n) if len(counted) <= BROADCAST_LABELS else n
    cut = n.select(label, F.ceil(F.lit(float(1 << 30)) * F.least(F.lit(1.0), 1.25 * most / F.col("__n") + 30 / F.col("__n"))).alias("__cut"))
    drawn = rows.join(cut, label).withColumn("__u", u).where("__u < __cut")
    order = Window.partitionBy(label).orderBy("__u", key)
    return drawn.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most).drop("__u", "__r", "__cut")
