"""Each operator against brute force on small tables, and on rows made to be awkward."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from quillon.llm import components, language_id, minhash_forest, projection_dedup, quality_knn, scaled_sketch, secret_ledger, sentencepiece_codec, source_mixing, suffix_dedup, textkit, url_lists
from quillon.llm.queries import ORACLES, QUERIES
from quillon.tables import table

LONG = " ".join(f"word{i}" for i in range(30_000))
#: Nulls in any column, empty and white text, ties, repeated rows, one very long text, and columns whose
#: names clash with those the operators make.
AWKWARD = [
    (1, "one two three four five six", "en", "a", 5), (2, "one two three four five six", "en", "a", 5), (3, None, "en", "a", None), (4, "", None, "b", 0),
    (5, " \t\n", "en", None, 3), (6, "ONE  two\tthree four five six", "en", "b", 5), (7, "short", "fr", "b", 5), (8, LONG, "en", "a", len(LONG)), (9, LONG + " tail", "en", "c", 1),
    (None, "no id here at all", None, "c", 1), (10, "été ß 漢字 ▁ \U0001f600", "fr", "c", 9), (10, "été ß 漢字 ▁ \U0001f600", "fr", "c", 9), (11, "12 34 !!", "de", None, 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    extra = ["key", "part", "size", "score", "id", "blob", "component_id", "predicted", "a", "n", "k", "rank"]
    return spark.createDataFrame(AWKWARD, SCHEMA).select("*", *[F.lit(i).alias(n) for i, n in enumerate(extra)])


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def small(spark):
    return table(spark, SF, "documents")


def texts(spark) -> dict[int, str]:
    return {r.doc_id: r.text for r in small(spark).select("doc_id", "text").collect()}


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None, lower: bool = True) -> set[tuple[str, ...]]:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df())


# --- words and hashes ---------------------------------------------------------------------------------


def test_shingles_are_those_of_python():
    import pyarrow as pa

    column = pa.array([r[1] for r in AWKWARD])
    for lo, hi, data, off in textkit.slices(column):
        sh, at = textkit.Shingler()(data, off)
        for i in range(lo, hi):
            assert len(set(sh[at[i - lo] : at[i - lo + 1]].tolist())) == len(shingles(AWKWARD[i][1]))
    same = textkit.Shingler()
    a, b = (next(iter(textkit.slices(pa.array([t])))) for t in ("x  y", "pad pad X\ty"))
    assert same(a[2], a[3])[0].tolist() != same(b[2], b[3])[0].tolist()


def test_components_of_a_chain_a_star_and_nulls(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for finish in (0, 1000):
        got = {r.id: r.root for r in components.connected_components(df, finish=finish).collect()}
        assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(30)}
    assert components.connected_components(df.limit(0)).count() == 0


# --- 1 SentencePiece ----------------------------------------------------------------------------------


def test_every_text_comes_back(spark, odd, none):
    assert QUERIES["op1_sentencepiece"](spark, SF).where("not round_trip").count() == 0
    out = sentencepiece_codec.encode(odd, check=True)
    rows = out.collect()
    assert len(rows) == len(AWKWARD) and all(r.round_trip for r in rows) and set(odd.columns) <= set(out.columns)
    back = sentencepiece_codec.decode(out.drop("text"))
    assert Counter(r.text for r in back.collect()) == Counter(r[1] for r in AWKWARD)
    assert sentencepiece_codec.encode(none).count() == 0


def _message(field: int, value: bytes) -> bytes:
    return bytes([field << 3 | 2]) + bytes([len(value)]) + value


def test_unigram_models_as_the_library_does():
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rng = np.random.default_rng(0)
    pieces += [(p, -float(rng.random() * 5 + len(p) * 0.2), 1) for p in ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "ca", "cab", "▁b", "bca", "▁▁"]]
    body = b"".join(_message(1, _message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, k])) for p, s, k in pieces)
    body += _message(2, bytes([3 << 3, 1])) + _message(3, _message(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))
    lib = sentencepiece.SentencePieceProcessor(model_proto=body)
    ours = sentencepiece_codec.Codec(body)
    for _ in range(200):
        text = "".join(rng.choice(list("abc  "), rng.integers(1, 25)))
        got, want = np.frombuffer(ours.encode(text), np.int32).tolist(), lib.encode(text)
        score = [s for _, s, _ in pieces]
        assert sum(score[i] for i in got) == pytest.approx(sum(score[i] for i in want), abs=1e-4) and ours.decode(ours.encode(text)) == text
        assert got == want or Counter(got) == Counter(want), text  # equal scores may be ordered either way


# --- 2 embeddings -------------------------------------------------------------------------------------


def test_links_are_all_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 24))
    x = np.concatenate([base, base[:20] + rng.standard_normal((20, 24)) * 0.22, base[:5] * 3.0, base[:1], base[:1]])
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(100, None), (101, [0.0] * 24), (102, [float("nan")] * 24), (103, [None] * 24), (104, []), (None, [1.0] * 24), (105, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1)).withColumn("n_links", F.lit(2))
    got = {r.vec_id: r for r in projection_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    near |= (np.abs(u @ u.T - 1) < 1e-12) & ~np.eye(len(x), dtype=bool)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.minimum(root, np.where(near, root[None, :], 10**6).min(axis=1))
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), root[i], root[i] == i)
    for i in (100, 101, 102, 103, 104, 105):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].component_id is None and projection_dedup.near_duplicates(df.limit(0)).count() == 0


def all_links(rows) -> dict[int, tuple[int, int]]:
    """(links, smallest id of the component) by id, from all pairs."""
    ids = np.array([i for i, _ in rows])
    u = np.stack([np.array(v) / np.linalg.norm(v) for _, v in rows])
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = ids.copy()
    while True:
        low = np.minimum(root, np.where(near, root[None, :], 2**62).min(axis=1))
        if (low == root).all():
            return {int(i): (int(n), int(r)) for i, n, r in zip(ids, near.sum(axis=1), root, strict=True)}
        root = low


@pytest.mark.parametrize("small", [False, True])
def test_groups_and_chains_against_all_pairs(spark, monkeypatch, small):
    """Dense groups, a chain of barely linked vectors, and scattered pairs; with cells and blocks of a few
    rows the large ones are cut."""
    if small:
        monkeypatch.setattr(projection_dedup, "CELL", 16)
        monkeypatch.setattr(projection_dedup, "BLOCK", 8)
        monkeypatch.setattr(projection_dedup, "PART", 3000)
    rng = np.random.default_rng(4)
    x = [rng.standard_normal(64) for _ in range(700)]
    for k, spread in ((0, 0.1), (1, 0.16), (2, 0.23)):
        x += [x[k] + rng.standard_normal(64) * spread for _ in range(150)]
    for k in range(40):  # each turns by an angle whose cosine is 0.96
        side = rng.standard_normal(64)
        u = x[-1] / np.linalg.norm(x[-1])
        side -= (side @ u) * u
        x.append(0.96 * u + 0.28 * side / np.linalg.norm(side))
    x += [v + rng.standard_normal(64) * 0.2 for v in x[100:300]]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)) + 5, x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in projection_dedup.near_duplicates(df).collect()}
    assert got == all_links(rows)


def test_repeated_ids_are_one_component(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (3, b), (4, c), (4, c)], "vec_id long, embedding array<double>")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in projection_dedup.near_duplicates(df).collect())
    assert got == Counter([(1, 1, 1, True), (2, 1, 1, False), (2, 2, 1, False), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (4, 1, 4, True)])


def test_orders_are_calibrated():
    """Of pairs just at the threshold, windows and count lose almost none; of random pairs few pass."""
    rng = np.random.default_rng(5)
    for dims in (8, 24, 64, 300):
        u = rng.standard_normal((4000, dims))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        side = rng.standard_normal((4000, dims))
        side -= (side * u).sum(axis=1, keepdims=True) * u
        v = 0.95 * u + np.sqrt(1 - 0.95**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
        bits, count = projection_dedup.orders(100_000)
        project = projection_dedup._projector(bits, count)
        (ca, ya, a), (cb, yb, b) = project(u), project(v)
        m = min(dims, projection_dedup.COUNTED)
        hits = (np.abs(a.astype(int) - b) <= 9)[:, :m].sum(axis=1)
        assert (hits >= projection_dedup.least_count(dims)).all()
        assert ((ca == cb) & (np.abs(ya - yb) <= projection_dedup.STEPS + 1)).any(axis=1).mean() > 0.999
        far = (np.abs(a.astype(int) - np.roll(b, 1, axis=0)) <= 9)[:, :m].sum(axis=1)
        assert dims < 24 or (far >= projection_dedup.least_count(dims)).mean() < 0.01


def test_recall_against_all_pairs(spark):
    x = {r.vec_id: np.array(r.embedding, float) for r in table(spark, SF, "embeddings").collect()}
    ids = sorted(x)
    u = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in QUERIES["op2_projection_dedup"](spark, SF).collect()}
    assert [got[i] for i in ids] == want.tolist()


# --- 3 mixing -----------------------------------------------------------------------------------------


def test_mix_meets_targets(spark, odd, none):
    rows = QUERIES["op3_source_mixing"](spark, SF).collect()
    assert sum({r.doc_id: r["size"] for r in rows}.values()) == sum(len(words(t)) for t in texts(spark).values())
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert QUERIES["op3_source_mixing"](spark, SF).select("doc_id", "taken").exceptAll(spark.createDataFrame([(r.doc_id, r.taken) for r in rows], "doc_id long, taken long")).count() == 0
    filled = dict((s, (n, t)) for s, n, t in source_mixing.water_fill([("a", 100), ("b", 100), (None, 10), ("c", 0)]))
    assert filled["a"][1] == 200 and filled[None][1] == 20 and filled["b"][1] == pytest.approx(95) and filled["c"][1] == 0
    assert source_mixing.mix(odd).count() == len(AWKWARD) and source_mixing.mix(none).count() == 0
    assert source_mixing.repeat(odd).columns == odd.columns


def test_inclusion_differs_by_length_and_words_meet_the_target(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 5 == 0, 900).otherwise(20).cast("int")).alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    mixed = source_mixing.mix(docs)
    by_source = mixed.groupBy("target", "source_size").agg(F.sum("taken").alias("t")).collect()
    assert len(by_source) == 2 and all(abs(r.t - r.target) <= 900 for r in by_source)
    assert mixed.where("taken > 2 * size").count() == 0
    for r in by_source:
        n = r.source_size // 980  # of five documents, four are short
        long, short = source_mixing.expected([20 * 4 * n, 0, 0, 900 * n, 0], r.target)[3::-3]
        assert long * 900 * n + short * 80 * n == pytest.approx(r.target) and (short > long or r.target == 2 * r.source_size)
        got = {x["size"]: x.c for x in mixed.where(F.col("target") == r.target).groupBy("size").agg(F.avg("copies").alias("c")).collect()}
        assert got[20] == pytest.approx(short, abs=0.06) and got[900] == pytest.approx(long, abs=0.06)


def test_the_mix_repeats_whole_rows(spark, odd):
    docs = odd.withColumn("mark", F.monotonically_increasing_id())
    taken = Counter((r.doc_id, r["size"]) for r in source_mixing.mix(docs).collect() for _ in range(r.copies))
    got = source_mixing.repeat(docs)
    assert got.columns == docs.columns and Counter((r.doc_id, len(words(r.text or ""))) for r in got.collect()) == taken
    assert got.where("doc_id is null").count() > 0 and source_mixing.repeat(docs.limit(0)).count() == 0


# --- 4 secrets ----------------------------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    any_case = lambda w: "".join(f"[{c}{c.upper()}]" for c in w)
    names = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key")
    rules = [("assign", f"({names})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    return sorted((m.start(), i, k, m.end()) for i, (k, p, g, n) in enumerate(rules) for m in re.finditer(p, text) if len(m[g]) >= n)


SECRETS = ["password = 'hunter22x' and token:abc token:abcdef", "AKIA" + "A" * 16 + " AKIA123", "f" * 24 + "g" + "0" * 23, "ſecret=abcdefgh PassWd=\"Zz9_/+.=-\"", "api_key=apikey=abcdef", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----"]


def test_base_spans_stay(spark, odd, none):
    rows = [(i, t) for i, t in enumerate(SECRETS + SECRETS[:2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for source, all_texts in ((df, dict(rows)), (small(spark), texts(spark))):
        for r in secret_ledger.find_secrets(source).collect():
            base = base_spans(all_texts[r.doc_id] or "")
            name = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
            kinds = [k for _, _, k, _ in base]
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in secret_ledger.BASE)
            assert r.base_sha256 == hashlib.sha256(name.encode()).hexdigest()
            assert set(name.split(",")) - {""} <= set(r.spans.split(","))
    assert secret_ledger.find_secrets(odd).count() == len(AWKWARD) and secret_ledger.find_secrets(none).count() == 0
    clean = {r.doc_id: r.text for r in secret_ledger.redact(df).collect()}
    assert clean[5] == "[SECRET]" and "hunter22x" not in clean[0] and len(clean) == len(rows)
    assert secret_ledger.redact(odd).columns == odd.columns and secret_ledger.redact(odd).count() == len(AWKWARD)


def test_pushes_change_no_finding_and_scan_a_text_once(spark, odd, monkeypatch):
    rows = [(i, SECRETS[i % 2] if i % 3 else f"token: abcdefgh{i % 7}") for i in range(40)] + [(None, SECRETS[0]), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scanned, scan = [], secret_ledger._scan_blobs
    monkeypatch.setattr(secret_ledger, "_scan_blobs", lambda blobs, version: scanned.append(blobs.select("blob").distinct().count()) or scan(blobs, version))
    found = [Counter(tuple(r) for r in secret_ledger.find_secrets(docs, pushes).collect()) for pushes in (1, 2, 3)]
    assert found[0] == found[1] == found[2] and sum(found[0].values()) == len(rows)
    assert scanned[0] == sum(scanned[1:3]) == sum(scanned[3:]) == docs.selectExpr("coalesce(text, '')").distinct().count()


def test_ledger_scans_only_unseen_blobs(spark):
    one = spark.createDataFrame([("a", SECRETS[0]), ("b", SECRETS[0]), ("c", "x")], "path string, content string")
    found, ledger = secret_ledger.scan_versions(one, "path", "content")
    assert ledger.count() == 2 and found.count() == 3
    two = spark.createDataFrame([("a", SECRETS[1]), ("d", SECRETS[0])], "path string, content string")
    found, grown = secret_ledger.scan_versions(two, "path", "content", ledger)
    assert grown.count() == 3 and {r.path: r.n_assign for r in found.collect()} == {"a": 0, "d": 2}
    assert secret_ledger.scan_versions(two, "path", "content", grown, version=2)[1].count() == 5


# --- 5 repeated substrings ----------------------------------------------------------------------------


def removed(all_texts: list[bytes]) -> list[np.ndarray]:
    seen: Counter = Counter(t[i : i + 400] for t in all_texts for i in range(len(t) - 399))
    out = []
    for t in all_texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        out.append(gone)
    return out


def check_removed(df, rows):
    raw = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), t, gone in zip(rows, raw, removed(raw), strict=True):
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == want


def test_covers_are_perfect():
    for u in suffix_dedup.units():
        assert len(u.cover) ** 2 - len(u.cover) + 1 == u.period and {(a - b) % u.period for a in u.cover for b in u.cover} == set(range(u.period))


def shared(rows) -> Counter:
    """(id, whether 51 words in a row also stand in another row's text)"""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    holders: dict[tuple, set] = {}
    for k, w in enumerate(texts):
        for i in range(len(w) - 50):
            holders.setdefault(tuple(w[i : i + 51]), set()).add(k)
    return Counter((i, any(len(holders[tuple(w[j : j + 51])]) > 1 for j in range(len(w) - 50))) for (i, _), w in zip(rows, texts, strict=True))


def test_shared_passages_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(400)]
    say = lambda n: list(rng.choice(vocabulary, n))
    base, line = say(120), say(30)
    rows = [(i, " ".join(say(int(rng.integers(0, 90))))) for i in range(10)]
    rows += [(20, " ".join(base)), (21, " ".join(say(40) + base[30:81] + say(9)).upper()), (22, "\n".join(say(7) + base[60:110])), (23, " ".join(base[:51])), (24, "no " * 200), (25, "go " * 70 + "so"), (26, "go\t" * 60), (27, None), (28, "")]
    rows += [(100 + i, " ".join(say(30) + line + say(30))) for i in range(40)]  # one line in many surroundings
    rows += [(200 + i, rows[-1 - i][1].split(" ", 12)[-1]) for i in range(3)]
    for parts in (1, 7):
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
        assert Counter((r.doc_id, r.shares_passage) for r in got.collect()) == shared(rows)


def test_a_line_in_many_surroundings(spark):
    rng = np.random.default_rng(9)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line = text(300)
    rows = [(i, text(150) + line + text(150)) for i in range(60)]
    rows += [(100 + i, rows[i][1][60:520]) for i in range(0, 60, 7)]
    for parts in (1, 6):
        check_removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), rows)


def test_repeats_in_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check_removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_worker_functions_need_no_package():
    """Functions that tasks run are unpickled where the package cannot be imported."""
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle

    from quillon.llm import projection_dedup as p

    functions = [suffix_dedup._sample(3, 3), suffix_dedup._settle(3), suffix_dedup._strings(3, 3), suffix_dedup._finish(), minhash_forest._signer(), secret_ledger.scanner(), p.worker_functions()]
    code = "import sys, pickle; sys.path = [x for x in sys.path if 'repo' not in x]; f = pickle.loads(sys.stdin.buffer.read()); import importlib.util as u; assert u.find_spec('quillon') is None"
    raw = cloudpickle.dumps(functions)
    assert pickle.loads(raw)
    subprocess.run([sys.executable, "-c", code], input=raw, check=True, cwd="/", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_repeats_against_brute_force(spark, none):
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdé "))
    base = "".join(rng.choice(letters, 3000))
    rows = [(i, "".join(rng.choice(letters, int(rng.integers(0, 900))))) for i in range(12)]
    rows += [(20, base), (21, "x" * 37 + base[500:1700] + "y"), (22, base[900:1290]), (23, base[900:1310]), (24, "zz" + base[2500:] + base[:450]), (25, "q" * 1000), (26, None), (27, ""), (28, "r" * 399), (29, "ab" * 260 + "c" + "ab" * 260)]
    cut = list(base)
    cut[::450] = "#" * len(cut[::450])
    rows.append((30, "".join(cut)))
    check_removed(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("part", F.lit(1)).repartition(5), rows)
    again = rows + [(20, base), (20, base[:800]), (None, base[100:900]), (None, "e" * 500)]
    check_removed(spark.createDataFrame(again, "doc_id long, text string").repartition(3), again)
    assert suffix_dedup.remove_repeats(none).count() == 0


# --- 6 language ---------------------------------------------------------------------------------------


def test_language_held_out(spark, odd, none):
    truth = {r.doc_id: r.lang for r in small(spark).collect()}
    rows = language_id.predict_held_out(small(spark)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.9
    got = language_id.predict_held_out(odd).collect()
    assert len(got) == len(AWKWARD) and {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 11)} == {"und"}
    assert language_id.predict_held_out(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predict_held_out(unlabelled).collect()} == {"und"}


# --- 7 URLs -------------------------------------------------------------------------------------------


def test_entries_hold_from_add_to_remove(spark):
    entries = [("l", "bad.com", "add", 10), ("l", "bad.com", "remove", 20), ("l", "bad.com", "add", 30), ("m", "x.org/ads", "add", 5), ("l", "same.com", "add", 7), ("l", "same.com", "remove", 7), (None, "bad.com", "add", 0), ("l", "bad.com", "add", 10)]
    e = spark.createDataFrame(entries, "list string, key string, action string, day long")
    caps = [("http://bad.com/a", 9), ("http://bad.com/a", 10), ("https://www.BAD.com:80/", 19), ("http://bad.com/a", 20), ("http://bad.com/a", 99), ("http://notbad.com/", 15), ("http://x.org/ads/1?q", 6), ("http://x.org/adsy", 6), ("http://same.com/", 7), (None, 15), ("junk", 15), ("http://bad.com/a", None), ("http://bad.com/a", 10)]
    df = spark.createDataFrame(caps, "url string, fetch_day long").withColumn("key", F.lit("k")).withColumn("lists", F.lit("z")).withColumn("n", F.lit(1))
    out = url_lists.evaluate(df, e)
    got = Counter((r.url, r.fetch_day, r.blocked, r.lists) for r in out.collect())
    blocked = {caps[1]: "l", caps[2]: "l", caps[4]: "l", caps[6]: "m"}
    assert got == Counter((*c, c in blocked, blocked.get(c, "")) for c in caps) and out.columns.count("n") == 1
    assert not any(r.blocked for r in url_lists.evaluate(df, e.limit(0)).collect()) and url_lists.evaluate(df.limit(0), e).count() == 0


# --- 8 fingerprints -----------------------------------------------------------------------------------


def check_edited(rows, got):
    ordered = sorted(rows, key=lambda r: -r[0])
    for i, (doc, text) in enumerate(ordered):
        t, other = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        assert got[doc].n_chars == len(t) and got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t, False), shingles(edited, False)
        if len(a | b) > 400:
            assert abs(got[doc].near_edited - len(a & b) / len(a | b)) < 0.25


def test_fingerprints(spark, odd, none):
    all_texts = texts(spark)
    got = {r.doc_id: r for r in scaled_sketch.fingerprints(small(spark)).collect()}
    check_edited(list(all_texts.items()), got)
    by_text: dict = {}
    for d, t in all_texts.items():
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint
    out = scaled_sketch.fingerprints(odd)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Pandas" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.fingerprint for r in rows if r.doc_id in (3, 4, 5)} == {""}
    assert next(r for r in rows if r.doc_id == 2).near_next == 1.0 and scaled_sketch.fingerprints(none).count() == 0
    one = spark.createDataFrame([(7, "abcd")], "doc_id long, text string")
    assert scaled_sketch.fingerprints(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_sketches_merge_and_contain(spark):
    a, b = " ".join(f"a{i}" for i in range(4000)), " ".join(f"a{i}" for i in range(400))
    df = spark.createDataFrame([(a, b)], "x string, y string")
    df = scaled_sketch.with_sketch(scaled_sketch.with_sketch(df, "x", "sx"), "y", "sy")
    r = df.select(scaled_sketch.containment("sy", "sx").alias("c"), scaled_sketch.likeness("sx", "sy").alias("j"), (scaled_sketch.merge("sx", "sy") == F.col("sx")).alias("m")).first()
    assert r.c == 1.0 and 0.05 < r.j < 0.16 and r.m


# --- 9 quality ----------------------------------------------------------------------------------------


def test_quality_held_out(spark, odd, none):
    docs, lab = small(spark), table(spark, SF, "labels")
    rows = quality_knn.predict_held_out(docs, lab).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.quality for r in lab.collect()}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([(s >= 0.3) == bool(q) for s, q in held]) > 0.8
    some = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (8, None, 0), (None, 1, 0), (2, 1, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality_knn.predict_held_out(odd, some).collect()
    assert len(got) == len(AWKWARD) and {r.score for r in got if r.doc_id in (3, 4)} == {0.0}
    assert quality_knn.predict_held_out(odd, some.limit(0)).where("score > 0").count() == 0
    assert quality_knn.predict_held_out(none, some).count() == 0
    assert quality_knn.keep_good(odd, some).columns == odd.columns


# --- 10 near duplicates -------------------------------------------------------------------------------


def near_components(rows, least: int = 85) -> dict:
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= least * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize("region", [4096, 8])
def test_near_duplicates_against_all_pairs(spark, region, monkeypatch):
    monkeypatch.setattr(minhash_forest, "REGION", region)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, i = [], 0
    for size, copies in ((300, 25), (60, 10), (8, 4), (150, 1), (150, 1)):
        base = rng.choice(vocabulary, size).tolist()
        for _ in range(copies):
            w = list(base)
            for p in rng.integers(0, size, int(rng.integers(0, 1 + size // 60))):
                w[p] = "edit" + str(rng.integers(1000))
            rows.append((i, " ".join(w)))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in minhash_forest.near_duplicates(df).collect()}
    want = near_components(rows)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.kept == (r.component_id == d) and r.n_shingles == len(shingles(dict(rows)[d])) for d, r in got.items())


def test_near_duplicates_of_awkward_rows(spark, odd, none):
    got = minhash_forest.near_duplicates(odd).collect()
    want = near_components([r[:2] for r in AWKWARD])
    assert len(got) == len(AWKWARD) and all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert minhash_forest.near_duplicates(none).count() == 0
    kept = minhash_forest.keep_one(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 7, 8, 10, 11, None])


def test_near_duplicates_of_documents(spark):
    want = near_components(list(texts(spark).items()))
    got = {r.doc_id: r.component_id for r in QUERIES["op10_minhash_forest"](spark, SF).collect()}
    assert got == want


def test_every_text_of_an_id_links(spark):
    x, y, z = ("".join(f"{c}{i} " for i in range(60)) for c in "xyz")
    rows = [(7, x), (7, y), (7, y), (3, y + "end"), (9, x), (5, z), (6, z), (4, "alone")]
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(7, 3), (7, 3), (7, 3), (3, 3), (9, 3), (5, 5), (6, 5), (4, 4)])


def at_similarity(low: float, high: float, count: int) -> list[tuple[int, str]]:
    """Pairs of texts whose similarity is at least ``low`` and below ``high``."""
    rng, rows = np.random.default_rng(11), []
    while len(rows) < 2 * count:
        a = [f"v{x}" for x in rng.integers(0, 10_000, 150)]
        b = list(a)
        for p in rng.choice(29, int(rng.integers(2, 6)), replace=False):
            b[int(p) * 5 + 2] = "edit"
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        if low <= len(x & y) / len(x | y) < high:
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    return rows


def test_the_stage_links_from_0_8_and_the_query_from_0_85(spark):
    import corpus_pipeline

    rows = at_similarity(0.8, 0.85, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.kept for r in minhash_forest.near_duplicates(df).collect())
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, df, SF).collect()} == set(range(0, 40, 2))


def test_estimate_and_recall_follow_from_the_similarity():
    rng = np.random.default_rng(5)
    for similarity in (0.8, 0.85):
        est = (rng.binomial(256, similarity + (1 - similarity) / 256, 200_000) - 1) / 255
        assert (est < minhash_forest.least_estimate(similarity) - 1e-9).mean() <= 1.2 * minhash_forest.MISS
        assert minhash_forest.tree_recall(similarity) > 0.9997
    assert minhash_forest.ratio_of(0.85) == (17, 20) and minhash_forest.ratio_of(0.8) == (4, 5)


def test_regions_wider_than_the_neighbours_are_compared_whole(spark, monkeypatch):
    """Texts on one template, whose only link may lie beyond NEAR in every order that they share."""
    monkeypatch.setattr(minhash_forest, "NEAR", 1)
    rng = np.random.default_rng(17)
    template = [f"t{i}" for i in range(200)]
    ids, rows = rng.permutation(200).tolist(), []
    for pair in range(100):
        at = [int(p) * 5 + 2 for p in rng.choice(39, 4, replace=False)]
        for side in range(2):
            w = list(template)
            for n, p in enumerate(at):
                w[p] = f"own{pair}x{n}" + ("" if n == 0 else f"s{side}")
            rows.append((ids[2 * pair + side], " ".join(w)))
    want = near_components(rows)
    assert len(set(want.values())) == 100
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_the_last_round_runs_after_one_without_new_pairs(spark, monkeypatch):
    """The rounds of few candidates propose nothing, as when the best of each set are pairs that failed."""
    monkeypatch.setattr(minhash_forest, "NEAR", 1)
    every = minhash_forest._candidates
    monkeypatch.setattr(minhash_forest, "_candidates", lambda entries, most, *rest: every(entries, most, *rest).where(F.lit(most is None)))
    text = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(i, f"{text} end{i}") for i in range(3)], "doc_id long, text string")
    assert {r.component_id for r in minhash_forest.near_duplicates(df).collect()} == {0}


def test_the_estimate_cut_loses_one_in_a_million():
    for similarity in (0.8, 0.85):
        p, least = similarity + (1 - similarity) / 256, round(minhash_forest.least_estimate(similarity) * 255 + 1)
        assert (np.random.default_rng(6).binomial(256, p, 2_000_000) < least).mean() <= 2e-6
