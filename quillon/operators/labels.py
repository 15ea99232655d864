"""Labels of cells: enrichment in neighbourhoods, inference, correction, annotation, and short ids."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import chernoff, hypergeometric_tail, ratio
from quillon.operators import graph
from quillon.operators.specificity import robust_z, set_score_z
from quillon.tables import materialize


def local_enrichment(p: DataFrame, labels: DataFrame, n_labels: int | None = None) -> DataFrame:
    """(v, label, value): how far a label exceeds its share among a vertex's labelled neighbours, in nats.
    ``p(src, dst, weight)`` is row-stochastic by src; ``labels(v, label)`` may lack vertices or hold nulls."""
    known = labels.where("label is not null").select("v", "label")
    share = known.groupBy("label").agg(F.count("*").alias("c"))
    total = known.agg(F.count("*").alias("n"))
    share = share.crossJoin(F.broadcast(total)).select("label", (F.col("c") / F.col("n")).alias("share"))
    facts = p.groupBy("src").agg(F.sum(F.col("weight") * F.col("weight")).alias("w2"), F.max("weight").alias("a"))
    obs = p.join(F.broadcast(known.toDF("dst", "label")), "dst").groupBy("src", "label").agg(F.sum("weight").alias("o"))
    mass = F.sum("o").over(Window.partitionBy("src"))
    obs = obs.withColumn("o", F.col("o") / mass).join(facts, "src").join(F.broadcast(share), "label")
    return obs.select(F.col("src").alias("v"), "label", chernoff(F.col("o"), F.col("share"), F.col("w2") * F.col("share"), F.col("a"), natural=True).alias("value"))


def best_label(scores: DataFrame, by: str = "v") -> DataFrame:
    """(by, label, confidence): the label of the highest value; ties go to the first label."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round("value", 9)), "label")
    return scores.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(by, "label", F.col("value").alias("confidence"))


def infer_step(p: DataFrame, labels: DataFrame, n: int, sure: bool = True) -> DataFrame:
    """``labels(v, label)`` with missing labels filled where the confidence exceeds 3 + ln n (anywhere, if
    not ``sure``)."""
    best = best_label(local_enrichment(p, labels)).toDF("v", "found", "confidence")
    least = 3 + math.log(n) if sure else 0.0
    fill = F.when((F.col("confidence") > least) if sure else F.col("found").isNotNull(), F.col("found"))
    return labels.join(best, "v", "left").select("v", F.coalesce("label", fill).alias("label"))


def infer_missing(edges: DataFrame, labels: DataFrame, double: bool = False, max_iter: int = 3) -> DataFrame:
    """Missing labels from neighbours, in rounds, the last of which fills whatever has a neighbour."""
    p = materialize(graph.double_stochastic(edges, double), "transition")
    n = labels.count()
    for _ in range(max_iter):
        labels = materialize(infer_step(p, labels, n), "labels")
    return materialize(infer_step(p, labels, n, False), "labels")


def correct_step(p: DataFrame, labels: DataFrame, ratio_threshold: float = 2.0) -> DataFrame:
    """(v, label, changed): labels replaced where log2(best / own value) exceeds the threshold; a label
    without value counts as 1e-10."""
    scores = local_enrichment(p, labels)
    best = best_label(scores).toDF("v", "found", "top")
    own = labels.join(scores, ["v", "label"], "left").select("v", F.col("label").alias("old"), F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(1e-10)).alias("own"))
    both = own.join(best, "v", "left")
    switch = F.coalesce((F.col("found") != F.col("old")) & (F.log2(F.greatest(F.col("top"), F.lit(1e-10)) / F.col("own")) > ratio_threshold), F.lit(False))
    return both.select("v", F.when(switch, F.col("found")).otherwise(F.col("old")).alias("label"), switch.alias("changed"))


def correct(edges: DataFrame, labels: DataFrame, ratio_threshold: float = 2.0, double: bool = False, max_iter: int = 3, min_fraction: float = 0.001) -> DataFrame:
    """Labels of less than ``min_fraction`` of cells are inferred anew, then wrong ones corrected in rounds."""
    n = labels.count()
    big = labels.where("label is not null").groupBy("label").count().where(F.col("count") >= min_fraction * n).select("label")
    kept = labels.join(F.broadcast(big.withColumn("ok", F.lit(True))), "label", "left").select("v", F.when(F.col("ok"), F.col("label")).alias("label"))
    labels = infer_missing(edges, kept, double, 1)
    p = materialize(graph.double_stochastic(edges, double), "transition")
    for _ in range(max_iter):
        new = materialize(correct_step(p, labels, ratio_threshold), "labels")
        labels = new.select("v", "label")
        if new.where("changed").isEmpty():
            break
    return labels


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label_a, label_b, n, value): the hypergeometric bound of each pair's overlap, 0 for none, for two
    labellings (cell_id, label) of the cells that have both."""
    both = a.toDF("cell_id", "label_a").join(b.toDF("cell_id", "label_b"), "cell_id").where("label_a is not null and label_b is not null")
    n = both.groupBy("label_a", "label_b").agg(F.count("*").alias("n"))
    na, nb = n.groupBy("label_a").agg(F.sum("n").alias("na")), n.groupBy("label_b").agg(F.sum("n").alias("nb"))
    total = n.agg(F.sum("n").alias("total"))
    grid = na.crossJoin(F.broadcast(nb)).crossJoin(F.broadcast(total)).join(n, ["label_a", "label_b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return grid.select("label_a", "label_b", "n", hypergeometric_tail("total", "na", "nb", "n").alias("value"))


def map_clusters(labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, label, weight): clusters matched with labels by the largest total overlap bound, each at
    most 300 decades."""
    scores = overlap(labels, clusters).select(F.col("label_b").alias("src"), F.col("label_a").alias("dst"), F.least(F.col("value") / math.log(10), F.lit(300.0)).alias("weight"))
    return graph.max_weight_matching(scores).toDF("cluster", "label", "weight")


def cell_scores(h: DataFrame, enrichment: DataFrame, scale: bool = True) -> DataFrame:
    """(cell_id, label, value): H times exp of the enrichment ``(arch, label, value)``, which is first
    standardized over all entries and clipped to 3."""
    e = enrichment
    if scale:
        s = e.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
        z = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), ratio(F.col("value") - F.col("m"), F.col("s"))))
        e = e.crossJoin(F.broadcast(s)).select("arch", "label", F.exp(z).alias("value"))
    return h.join(F.broadcast(e.withColumnRenamed("value", "e")), "arch").groupBy("cell_id", "label").agg(F.sum(F.col("value") * F.col("e")).alias("value"))


def annotate_by_markers(scores: DataFrame, markers: DataFrame, n_rows: int) -> DataFrame:
    """(group, label, confidence): the cell type whose signed markers stand out most in each group's scores."""
    z = set_score_z(scores, markers.withColumnRenamed("celltype", "set_name"), n_rows)
    return best_label(z.select("group", F.col("set_name").alias("label"), F.col("z").alias("value")), "group")


def add_annotation(store: DataFrame | None, labels: DataFrame, name: str) -> DataFrame:
    """``store`` with the labels (cell_id, label, label_name[, confidence]) appended under a name and tag."""
    confidence = F.col("confidence") if "confidence" in labels.columns else F.lit(None)
    row = labels.select(F.lit(name).alias("name"), F.sha2(F.lit(name), 256).substr(1, 8).alias("tag"), F.current_timestamp().alias("created_at"), "cell_id", "label", "label_name", confidence.cast("double").alias("confidence"))
    return row if store is None else store.where(F.col("name") != name).unionByName(row)


def annotations_wide(store: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row for each cell, one column for each annotation."""
    return store.groupBy("cell_id").pivot("name", names).agg(F.first("label_name"))


def highlight(edges: DataFrame, labels: DataFrame, z_threshold: float = -1.0) -> DataFrame:
    """(v, label, z, core): PageRank by core number inside each label's subgraph, robustly standardized;
    cells alone in their label have -3. ``edges`` may be lists by dst of a graph that stores both directions."""
    if graph._as_lists(edges):
        inner = materialize(graph.within(edges, labels.where("label is not null").select("v", "label")), "highlight-lists", "zstd")
    else:
        e = edges.join(F.broadcast(labels.toDF("src", "la")), "src").join(F.broadcast(labels.toDF("dst", "lb")), "dst").where("la = lb").select("src", "dst", "weight", F.col("la").alias("label"))
        inner = materialize(e, "highlight-edges")
    core = graph.k_core(inner).select("v", F.col("core").cast("double").alias("value"))
    start = core.join(labels, "v").select(F.col("label").alias("key"), "v", "value")
    pr = graph.pagerank(inner.select("dst", "src", "weight"), start, labels.select("v"), 0.85, 10)
    z = robust_z(pr.select(F.col("key").alias("label"), "v", "value"), "label").select("v", "z")
    out = labels.join(z, "v", "left").withColumn("z", F.coalesce("z", F.lit(-3.0)))
    return out.select("v", "label", "z", (F.col("z") >= z_threshold).alias("core"))


# --- short ids by the published hashids scheme --------------------------------------------------------

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ1234567890"
SEPARATORS = "cfhistuCFHISTU"


def _mixed(text: str, salt: str) -> str:
    """``text`` reordered by ``salt``."""
    if not salt:
        return text
    out, at, total = list(text), 0, 0
    for i in range(len(out) - 1, 0, -1):
        code = ord(salt[at])
        total += code
        j = (code + at + total) % i
        out[i], out[j] = out[j], out[i]
        at = (at + 1) % len(salt)
    return "".join(out)


class HashIds:
    """Encodes non-negative integers as short strings, and back."""

    def __init__(self, salt: str = "", min_length: int = 0, alphabet: str = ALPHABET) -> None:
        seps = "".join(c for c in SEPARATORS if c in alphabet)
        letters = "".join(dict.fromkeys(c for c in alphabet if c not in seps))
        seps = _mixed(seps, salt)
        want = math.ceil(len(letters) / 3.5)
        if not seps or len(letters) / len(seps) > 3.5:
            want = max(want, 2)
            if want > len(seps):
                seps, letters = seps + letters[: want - len(seps)], letters[want - len(seps) :]
        letters = _mixed(letters, salt)
        n = math.ceil(len(letters) / 12)
        if len(letters) < 3:
            self.guards, seps = seps[:n], seps[n:]
        else:
            self.guards, letters = letters[:n], letters[n:]
        self.salt, self.min_length, self.letters, self.seps = salt, min_length, letters, seps

    @staticmethod
    def _digits(x: int, letters: str) -> str:
        out = ""
        while True:
            x, r = divmod(x, len(letters))
            out = letters[r] + out
            if not x:
                return out

    def encode(self, *values: int) -> str:
        if not values or min(values) < 0:
            return ""
        total = sum(v % (i + 100) for i, v in enumerate(values))
        letters = self.letters
        first = out = letters[total % len(letters)]
        for i, v in enumerate(values):
            letters = _mixed(letters, (first + self.salt + letters)[: len(letters)])
            piece = self._digits(v, letters)
            out += piece
            if i + 1 < len(values):
                out += self.seps[v % (ord(piece[0]) + i) % len(self.seps)]
        if len(out) < self.min_length:
            out = self.guards[(total + ord(out[0])) % len(self.guards)] + out
        if len(out) < self.min_length:
            out += self.guards[(total + ord(out[2])) % len(self.guards)]
        half = len(letters) // 2
        while len(out) < self.min_length:
            letters = _mixed(letters, letters)
            out = letters[half:] + out + letters[:half]
            over = len(out) - self.min_length
            if over > 0:
                out = out[over // 2 : over // 2 + self.min_length]
        return out

    def decode(self, text: str) -> tuple[int, ...]:
        """The integers, or none if ``text`` is not an encoding."""
        parts = text
        for g in self.guards:
            parts = parts.replace(g, "\0")
        fields = parts.split("\0")
        body = fields[1] if len(fields) in (2, 3) else fields[0]
        if not body:
            return ()
        first, rest, letters, out = body[0], body[1:], self.letters, []
        for s in self.seps:
            rest = rest.replace(s, "\0")
        for piece in rest.split("\0"):
            letters = _mixed(letters, (first + self.salt + letters)[: len(letters)])
            x = 0
            for c in piece:
                if c not in letters:
                    return ()
                x = x * len(letters) + letters.index(c)
            out.append(x)
        return tuple(out) if self.encode(*out) == text else ()


def hash_ids(salt: str, min_length: int = 8) -> Callable:
    """A column function from an integer column to short ids."""
    coder = HashIds(salt, min_length)

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else coder.encode(int(v)))

    return run


def unhash_ids(salt: str, min_length: int = 8) -> Callable:
    coder = HashIds(salt, min_length)

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or not coder.decode(v) else coder.decode(v)[0]).astype("Int64")

    return run
