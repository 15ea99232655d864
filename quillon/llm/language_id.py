"""Language identification by nearest centroids.

Texts are unit TF-IDF vectors of hashed byte n-grams of their letters. Each language has several centroids, found by
spherical k-means on a bounded sample (PER_LANGUAGE texts of each). A text has the language of the
centroid with the highest cosine; ``rejected`` marks texts farther from it than nearly all training
texts are from theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.ngram_vectors import NgramCounter, bounded_sample, collect_vectors, count_vectors, inverse_frequency, unit_rows, weigh
from quillon.llm.textkit import slices

SIZES, DIMS = (2, 3, 4), 4096
PER_LANGUAGE, CENTROIDS, ROUNDS = 400, 4, 12
UNDETERMINED = "und"


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; starts from the text nearest the mean, then from the farthest ones."""
    k = min(k, len(x))
    centre = unit_rows(x.mean(axis=0, keepdims=True))
    start = [int((x @ centre[0]).argmax())]
    while len(start) < k:
        start.append(int((x @ x[start].T).max(axis=1).argmin()))
    c = x[start]
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        c = unit_rows(np.stack([x[of == j].mean(axis=0) if (of == j).any() else c[j] for j in range(k)]))
    return c


class CentroidModel:
    """Centroids of all languages, fitted from (language, counts)."""

    def __init__(self, labels: list[str], counts: np.ndarray) -> None:
        self.names = sorted(set(labels))
        self.idf = inverse_frequency(counts)
        x, y = weigh(counts, self.idf), np.array(labels)
        parts = [spherical_kmeans(x[y == n], CENTROIDS) for n in self.names]
        self.centroids = np.concatenate(parts)
        self.of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        near = (x @ self.centroids.T).max(axis=1)
        self.reject = float(np.quantile(near, 0.005)) * 0.9

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        cos = weigh(counts, self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        return [self.names[self.of[b]] for b in best], np.clip(cos[np.arange(len(cos)), best], 0, 1).astype(np.float64)


def fit(docs: DataFrame) -> CentroidModel | None:
    """From the non-null ``text`` and ``lang`` of ``docs``; None without any."""
    ids = docs.where("text is not null and lang is not null and doc_id is not null").select("doc_id", F.col("lang").alias("label"))
    drawn = bounded_sample(ids, "label", PER_LANGUAGE).select("doc_id").distinct()
    picked = docs.where("text is not null and lang is not null").join(F.broadcast(drawn), "doc_id", "left_semi")
    found, counts = collect_vectors(count_vectors(picked.select("text", F.col("lang").alias("label")), NgramCounter(SIZES, DIMS, True), "string"))
    return CentroidModel(found, counts) if found else None


def has_letter(text: np.ndarray) -> bool:
    low = text | 32
    return bool(((low >= 97) & (low <= 122)).any()) or any(c.isalpha() for c in text[text >= 128].tobytes().decode(errors="ignore"))


def identify(docs: DataFrame, model: CentroidModel | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything when nothing was
    learned. Score is the cosine to the nearest centroid; of equal cosines the first language by name
    counts. Whole texts are read; equal texts have equal results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = NgramCounter(SIZES, DIMS, True)
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1)):
                lettered = [has_letter(data[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
                lang, score, rejected = [UNDETERMINED] * (hi - lo), np.zeros(hi - lo), np.zeros(hi - lo, bool)
                rows = np.flatnonzero(lettered)
                if len(rows) and model is not None:
                    for at in range(0, len(rows), 512):
                        some = rows[at : at + 512]
                        names, s = model.predict(np.stack([counter(data[off[i] : off[i + 1]]) for i in some]))
                        for i, n in zip(some.tolist(), names, strict=True):
                            lang[i] = n
                        score[some], rejected[some] = s, s < model.reject
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lang), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def fold(parts: int):
    """The fold of a row: crc32 of its id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def predict_held_out(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected); learned only from rows that are not held out."""
    model = fit(docs.where(fold(parts) != held))
    return identify(docs, model).select("doc_id", (fold(parts) == held).alias("held_out"), "lang_pred", "score", "rejected")
