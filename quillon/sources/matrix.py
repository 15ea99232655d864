"""Count matrices from frames, delimited files, MatrixMarket folders and Parquet bundles."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.filters import prefilter


@dataclass
class Experiment:
    """A bundle of frames: assays by name in long form, annotations of features and cells, reduced
    vectors, and metadata."""

    assays: dict[str, DataFrame]
    features: DataFrame
    cells: DataFrame
    reduced: dict[str, DataFrame] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)

    def assay(self, *names: str) -> DataFrame:
        for n in names:
            if n in self.assays:
                return self.assays[n]
        raise KeyError(f"no assay {' or '.join(names)}; there are {sorted(self.assays)}")

    def with_assay(self, name: str, frame: DataFrame) -> Experiment:
        return Experiment({**self.assays, name: frame}, self.features, self.cells, self.reduced, self.metadata)

    def save(self, path: str) -> None:
        """One Parquet table for each frame below ``path``."""
        for n, df in self.assays.items():
            df.write.mode("overwrite").parquet(f"{path}/assays/{n}")
        for n, df in self.reduced.items():
            df.write.mode("overwrite").parquet(f"{path}/reduced/{n}")
        self.features.write.mode("overwrite").parquet(f"{path}/features")
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")


def load(spark: SparkSession, path: str, assays: tuple[str, ...] = ("counts",), reduced: tuple[str, ...] = ()) -> Experiment:
    read = spark.read.parquet
    return Experiment({n: read(f"{path}/assays/{n}") for n in assays}, read(f"{path}/features"), read(f"{path}/cells"), {n: read(f"{path}/reduced/{n}") for n in reduced})


def from_frames(counts: DataFrame, features: DataFrame | None = None, cells: DataFrame | None = None, filtered: bool = False, min_cell_fraction: float = 0.001, min_features: int = 300) -> Experiment:
    """From long-form counts; zeros and nulls are dropped. Annotations default to the ids that occur."""
    clean = counts.select("feature_id", "cell_id", F.col("value").cast("double").alias("value")).where("value is not null and value != 0")
    features = features if features is not None else clean.select("feature_id").distinct()
    cells = cells if cells is not None else clean.select("cell_id").distinct()
    if filtered:
        clean = prefilter(clean, cells.count(), min_cell_fraction, min_features)
        features = features.join(clean.select("feature_id").distinct(), "feature_id", "left_semi")
        cells = cells.join(clean.select("cell_id").distinct(), "cell_id", "left_semi")
    return Experiment({"counts": clean}, features, cells)


def wide_to_long(wide: DataFrame, id_col: str) -> DataFrame:
    """Rows are features and the other columns are cells."""
    cells = [c for c in wide.columns if c != id_col]
    typed = wide.select(F.col(f"`{id_col}`").cast("string").alias("feature_id"), *[F.col(f"`{c}`").cast("double").alias(c) for c in cells])
    return typed.unpivot(["feature_id"], [F.col(f"`{c}`") for c in cells], "cell_id", "value").where("value is not null and value != 0")


def read_table(spark: SparkSession, path: str, sep: str = "\t", header: bool = True, **options) -> Experiment:
    """A delimited matrix; the first column, if it is not a number, names the features."""
    wide = spark.read.csv(path, sep=sep, header=header, inferSchema=True)
    first, kind = wide.dtypes[0]
    if kind != "string":
        raise ValueError("the first column must name the features")
    return from_frames(wide_to_long(wide, first), **options)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line): lines of an annotation file by their place from 1. Such a file is one row to Spark."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split(F.regexp_replace("value", "\\r?\\n$", ""), "\\r?\\n")).alias("at", "line"))
    return lines.withColumn("at", F.col("at") + 1)


def read_matrix_market(spark: SparkSession, path: str, matrix: str = "matrix.mtx.gz", features: str = "features.tsv.gz", barcodes: str = "barcodes.tsv.gz", sep: str = "\t", **options) -> Experiment:
    """A MatrixMarket folder with feature and cell tables. One feature column is a name; two are id and
    name; a third is the type. Types other than gene expression become matrices of their own under
    ``reduced``. Features are called name, or id_name where there is an id."""
    f = _lines(spark, f"{path}/{features}").withColumn("c", F.split("line", sep))
    n = F.size("c")
    f = f.select(
        "at", F.when(n >= 2, F.concat_ws("_", F.col("c")[0], F.col("c")[1])).otherwise(F.col("c")[0]).alias("feature_id"),
        F.when(n >= 2, F.col("c")[1]).otherwise(F.col("c")[0]).alias("name"), F.when(n >= 3, F.try_element_at("c", F.lit(3))).otherwise("Gene Expression").alias("type"),
    )
    b = _lines(spark, f"{path}/{barcodes}").select("at", F.split("line", sep)[0].alias("cell_id"))
    body = spark.read.text(f"{path}/{matrix}").where(~F.col("value").startswith("%")).withColumn("c", F.split(F.trim("value"), "\\s+"))
    size = body.select(F.trim("value")).first()[0]  # the dimensions come first
    triples = F.col("c")[0].cast("long").alias("i"), F.col("c")[1].cast("long").alias("j"), F.col("c")[2].cast("double").alias("value")
    coo = body.where(F.trim("value") != size).select(*triples)
    again = body.where(F.trim("value") == size)
    if again.count() > 1:  # an entry that reads like them
        coo = coo.union(again.limit(1).select(*triples))
    full = coo.join(f, coo["i"] == f["at"]).drop("at").join(b, F.col("j") == b["at"]).select("feature_id", "cell_id", "value", "type")
    genes = from_frames(full.where("type = 'Gene Expression'"), f.where("type = 'Gene Expression'").select("feature_id", "name"), b.select("cell_id"), **options)
    for kind in [r[0] for r in f.where("type != 'Gene Expression'").select("type").distinct().orderBy("type").collect()]:
        genes.reduced[kind] = full.where(F.col("type") == kind).select("feature_id", "cell_id", "value")
    return genes


def convert_feature_ids(assay: DataFrame, mapping: DataFrame) -> DataFrame:
    """Renames features by ``mapping(feature_id, name)``: the first name in order, '' where there is none."""
    first = mapping.where("name is not null").groupBy("feature_id").agg(F.min("name").alias("name"))
    return assay.join(first, "feature_id", "left").withColumn("feature_id", F.coalesce("name", F.lit(""))).drop("name")
