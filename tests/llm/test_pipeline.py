"""The pipeline's stages, one on the other, and on awkward rows."""

from __future__ import annotations

from collections import Counter

from conftest import SF
from pyspark.sql import functions as F
from test_operators import AWKWARD, SCHEMA, near_components

import corpus_pipeline
from quillon.llm import quality_knn, secret_ledger
from quillon.tables import materialize, table


def test_stages_follow_one_another(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_knn", "minhash_near_dedup", "secret_scan", "source_mixing", "sentencepiece"]
    good = materialize(steps["quality_knn"](spark, docs, SF), "t")
    model = quality_knn.predict_held_out(docs, table(spark, SF, "labels"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in model.where("predicted = 1").collect()}
    one = materialize(steps["minhash_near_dedup"](spark, good, SF), "t")
    want = near_components([(r.doc_id, r.text) for r in good.collect()], 80)
    assert {r.doc_id for r in one.collect()} == {i for i, root in want.items() if i == root}
    clean = materialize(steps["secret_scan"](spark, one, SF), "t")
    assert clean.count() == one.count() and secret_ledger.find_secrets(clean).where("spans != ''").count() == 0
    mixed = materialize(steps["source_mixing"](spark, clean, SF), "t")
    assert all(df.columns == names for df in (good, one, clean, mixed))
    out = steps["sentencepiece"](spark, mixed, SF)
    assert out.count() == mixed.count() and out.where("not round_trip").count() == 0


def test_stages_on_awkward_rows(spark):
    """Each stage on the same rows: what stays is as its docstring says."""
    docs = spark.createDataFrame(AWKWARD, SCHEMA).withColumn("rank", F.lit(1))
    steps = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0 and (name == "sentencepiece" or empty.columns == docs.columns)
    every = Counter((r.doc_id, r.text) for r in docs.collect())
    good = Counter((r.doc_id, r.text) for r in steps["quality_knn"](spark, docs, SF).collect())
    assert not good - every and all(n == every[k] for k, n in good.items())
    assert {t for _, t in good}.isdisjoint({t for _, t in every - good})
    one = steps["minhash_near_dedup"](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in one) == Counter([1, 3, 4, 5, 7, 8, 10, 11, None])
    clean = Counter((r.doc_id, r.text) for r in steps["secret_scan"](spark, docs, SF).collect())
    assert clean == every
    mixed = Counter((r.doc_id, r.text) for r in steps["source_mixing"](spark, docs, SF).collect())
    assert all(k in every and n <= 2 * every[k] and (k[1] or "").strip() for k, n in mixed.items())
    coded = steps["sentencepiece"](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in coded) == Counter(i for i, *_ in AWKWARD) and all(r.round_trip for r in coded)
    assert all((r.n_pieces or 0) == len(r.piece_ids or ()) for r in coded)
    rows = docs
    for _, stage in corpus_pipeline.STAGES:
        rows = materialize(stage(spark, rows, SF), "t")
    assert {r.doc_id for r in rows.collect()} <= {k[0] for k in mixed}
