"""Quality classification by nearest-neighbour voting.

A bounded sample of labelled texts (PER_CLASS of each label) is reduced to latent semantic vectors: unit
TF-IDF vectors of hashed byte n-grams and of style, projected on the leading right singular vectors. The labelled
vectors, of a size fixed by these parameters, travel with the task. Every text is compared with all of
them by exact cosine products, block by block, and its NEIGHBOURS nearest vote with their similarity,
weighted so that the sample's balance counts as that of all labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.language_id import fold
from quillon.llm.ngram_vectors import NgramCounter, bounded_sample, collect_vectors, count_vectors, inverse_frequency, unit_rows, weigh
from quillon.llm.textkit import slices

SIZES, DIMS, LATENT = (1, 2, 3), 4096, 64
PER_CLASS, NEIGHBOURS, SHARPNESS, THRESHOLD = 1000, 15, 8.0, 0.3


class NeighbourModel:
    """Latent vectors of labelled texts, fitted from (label, counts) and the labels' counts overall."""

    def __init__(self, labels: np.ndarray, counts: np.ndarray, overall: dict[int, int]) -> None:
        self.idf = inverse_frequency(counts)
        x = weigh(counts, self.idf)
        rng, k = np.random.default_rng(7), min(LATENT, *x.shape)
        q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], min(k + 10, *x.shape)), dtype=np.float32))[0]
        for _ in range(4):
            q = np.linalg.qr(x @ (x.T @ q))[0]
        _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
        self.basis = np.ascontiguousarray(vt[:k].T)
        self.points = unit_rows(x @ self.basis)
        self.labels = labels.astype(np.float32)
        total, share = sum(overall.values()), {c: float((labels == c).mean()) for c in set(labels.tolist())}
        self.weight = np.array([overall[c] / total / share[c] for c in labels.tolist()], np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        z = unit_rows(weigh(counts, self.idf) @ self.basis)
        cos = z @ self.points.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        vote = np.exp(SHARPNESS * (np.take_along_axis(cos, near, 1) - 1)) * self.weight[near]
        return np.clip((vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1), 0, 1).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame) -> NeighbourModel | None:
    """From ``labels(doc_id, quality)`` of 0 or 1 and the texts of ``docs``; None without any."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    overall = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = bounded_sample(known, "label", PER_CLASS)
    picked = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    found, counts = collect_vectors(count_vectors(picked, NgramCounter(SIZES, DIMS, False), "int"))
    return NeighbourModel(np.array(found), counts, overall) if found else None


def score(docs: DataFrame, model: NeighbourModel | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (score >= THRESHOLD),
    which replace columns of these names.

    Null and empty texts, and all texts when nothing was learned, score 0. Whole texts are read; equal
    texts score equally.
    """
    kept = docs.drop("score", "predicted")
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = NgramCounter(SIZES, DIMS, False)
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(at)):
                out = np.zeros(hi - lo)
                rows = np.flatnonzero(np.diff(off)) if model is not None else []
                for first in range(0, len(rows), 512):
                    some = rows[first : first + 512]
                    out[some] = model.score(np.stack([counter(data[off[i] : off[i + 1]]) for i in some]))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def predict_held_out(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted); learned only from labels of rows that are not held out."""
    model = fit(docs, labels.where(fold(parts) != held))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(base, model).select("doc_id", (fold(parts) == held).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with the columns of ``docs``. Null and empty
    texts score 0 and go; without labels to learn from, nothing is rejected."""
    names = docs.columns
    model = fit(docs, labels.where(fold(5) != 0))
    if model is None:
        return docs
    return score(docs.withColumnsRenamed({n: f"__{n}" for n in names if n in ("score", "predicted")}), model).where("predicted = 1").drop("score", "predicted").toDF(*names)
