"""Secret scans over an incremental blob ledger.

A blob is a distinct content, named by its SHA-256. The ledger holds (blob, rule version) pairs that
have been scanned, with their findings. A run addresses the content of every version of every path,
scans only pairs that the ledger lacks, one copy of each blob, and joins findings back to all paths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.tables import materialize, release

#: Rule set 1. The first three are the base; a match of fewer characters than the last number fails.
#: (kind, pattern, group whose length counts, least length, letters that a match must contain)
RULES_VERSION = 1
#: Pushes of the query; parts of a group of equal texts when spans are brought to them.
PUSHES, SALTS = 2, 16
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, False),
    ("hex", r"[0-9a-f]+", 0, 24, False),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39, False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 20, False),
    ("key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 20, False),
)
BASE = ("assign", "access", "hex")
_HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "github": ("gh",), "google": ("aiza",), "slack": ("xox",), "jwt": ("eyj",), "key": ("private key",)}


def scanner(rules=RULES):
    """A function from a text to its spans (start, rank of kind, kind, end) in code points, ordered."""
    made = []
    for rank, (kind, pattern, group, least, any_case) in enumerate(rules):
        if kind == "hex":  # whole runs, so a short run needs no match of its own
            pattern = r"[0-9a-f]{%d,}" % least
        made.append((rank, kind, re.compile(pattern, re.ASCII | (re.IGNORECASE if any_case else 0)), group, least, _HINTS.get(kind)))

    def scan(text: str) -> list[tuple[int, int, str, int]]:
        low, out = text.lower(), []
        for rank, kind, rule, group, least, hints in made:
            if hints is None or any(h in low for h in hints):
                out += [(m.start(), rank, kind, m.end()) for m in rule.finditer(text) if m.end(group) - m.start(group) >= least]
        return sorted(out)

    return scan


_FOUND = "blob string, rules int, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan_blobs(blobs: DataFrame, version: int) -> DataFrame:
    """Findings of ``blobs(blob, content)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for text in batch.column(1):
                spans = scan(text.as_py() or "")
                kinds = [s[2] for s in spans]
                base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans if k in BASE)
                row = (*(kinds.count(k) for k in BASE), hashlib.sha256(base.encode()).hexdigest() if base else nothing, ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(batch), pa.int32()), *arrays], names=["blob", "rules", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return blobs.select("blob", "content").mapInArrow(run, _FOUND)


def content_address(versions: DataFrame, path: str, content: str) -> DataFrame:
    """(path, blob): the SHA-256 of each version's content; null content is empty."""
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(text, 256).alias("blob"))


def scan_versions(versions: DataFrame, path: str, content: str, ledger: DataFrame | None = None, version: int = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings of every row of ``versions`` by path, the ledger with what this run added).

    ``ledger`` has the columns of the second result; without it nothing has been seen. Only blobs that
    it lacks under ``version`` are scanned, each once: the copy with the smallest path. Rows with a null
    path keep their findings under a null path; equal rows each get a row. Null content is empty and
    has no findings. Other columns are ignored; an empty table gives empty results.
    """
    named = materialize(content_address(versions, path, content), "secret-names")
    unseen = named.select("blob", "path")
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rules") == version).select("blob"), "blob", "left_anti")
    first = unseen.groupBy("blob").agg(F.min("path").alias("path"))
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    source = versions.select(F.col(path).alias("path"), text.alias("content"))
    # A path can have several versions, so the copy is checked by its name; nameless paths come as they are.
    nameless = first.where("path is null").select("blob")
    again = source.join(first.where("path is not null").select("path").distinct(), "path", "left_semi")
    again = again.withColumn("blob", F.sha2("content", 256)).join(first.select("blob"), "blob", "left_semi") if ledger is not None else again.withColumn("blob", F.sha2("content", 256))
    lone = source.where("path is null").withColumn("blob", F.sha2("content", 256)).join(nameless, "blob", "left_semi")
    found = materialize(_scan_blobs(again.unionByName(lone), version), "secret-findings").dropDuplicates(["blob", "rules"])
    release(versions.sparkSession)
    grown = found if ledger is None else ledger.unionByName(found)
    return named.join(grown.where(F.col("rules") == version), "blob"), grown


def find_secrets(docs: DataFrame, pushes: int = PUSHES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob) of each row of ``docs``.

    The rows arrive in ``pushes``, each row in the push that a hash of its id names; every push is scanned
    against the ledger that the ones before it left, so a text that came earlier is not scanned again.
    """
    push, ledger, found = F.pmod(F.xxhash64("doc_id"), F.lit(pushes)), None, []
    for k in range(pushes):
        part, ledger = scan_versions(docs.where(push == k), "doc_id", "text", ledger)
        found.append(part.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob"))
    return reduce(DataFrame.unionByName, found)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``, and ``n_chars``, if it is there, counted
    again. Overlapping spans become one mark. Rows without findings are unchanged."""
    found, _ = scan_versions(docs, "doc_id", "text")
    hit = found.where("spans != ''").select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans")).dropDuplicates(["__blob"])
    hit = hit.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = docs.withColumn("__blob", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(hit, ["__blob", "__salt"], "left")
    at, names = docs.columns.index("text"), docs.columns
    spans_at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column(spans_at).null_count < len(batch):
                texts = []
                for text, spans in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True):
                    if spans:
                        out, done, last = [], 0, -1
                        for a, b in (map(int, s.split(":")[1:]) for s in spans.split(",")):
                            if a >= last:
                                out += [text[done:a], mark]
                            last = done = max(last, b)
                        text = "".join([*out, text[done:]])
                    texts.append(text)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(batch.columns[:spans_at], names=names)

    out = joined.select(*names, "__spans").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
