"""Predicates, selections and relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: housekeeping features that marker analyses leave out.
BLACKLIST = r"\.|^RPL|^RPS|^MRP|^MT-|^MT|^RP|MALAT1|B2M|GAPDH"


def prefilter(assay: DataFrame, n_cells: int, min_cell_fraction: float = 0.001, min_features: int = 300) -> DataFrame:
    """Features in more than round(n_cells * fraction) cells, then cells with more than min_features of
    those; both counts are strict and of values other than zero."""
    least = round(n_cells * min_cell_fraction)
    some = assay.where("value > 0")
    features = some.groupBy("feature_id").agg(F.count("*").alias("n")).where(F.col("n") > least).select("feature_id")
    left = assay.join(features, "feature_id", "left_semi")
    cells = left.where("value > 0").groupBy("cell_id").agg(F.count("*").alias("n")).where(F.col("n") > min_features).select("cell_id")
    return left.join(cells, "cell_id", "left_semi")


def binarize(assay: DataFrame) -> DataFrame:
    return assay.withColumn("value", F.lit(1.0))


def threshold(assay: DataFrame, least: float) -> DataFrame:
    return assay.where(F.col("value") >= least)


def blacklisted(name: Column, pattern: str = BLACKLIST, ignore_case: bool = True) -> Column:
    return name.rlike(("(?i)" if ignore_case else "") + pattern)


def drop_blacklisted(frame: DataFrame, column: str = "feature_id", pattern: str = BLACKLIST) -> DataFrame:
    return frame.where(~blacklisted(F.col(column), pattern))


def filter_sets(sets: DataFrame, features: DataFrame, least: int = 3, most: int = 500) -> DataFrame:
    """The members of ``sets(set_name, feature_id)`` among ``features``, of sets with least..most of them."""
    inside = sets.select("set_name", "feature_id").distinct().join(features.select("feature_id").distinct(), "feature_id", "left_semi")
    sized = inside.groupBy("set_name").agg(F.count("*").alias("n")).where(F.col("n").between(least, most)).select("set_name")
    return inside.join(sized, "set_name", "left_semi")


def parse_markers(markers: DataFrame) -> DataFrame:
    """(celltype, feature_id, direction) from ``markers(celltype, marker)``: a sign at the end of a name
    gives the direction. Once any marker of a table has a sign, unsigned ones are dropped."""
    sign = F.regexp_extract("marker", r"([+-])$", 1)
    parsed = markers.select("celltype", F.regexp_replace("marker", r"[+-]$", "").alias("feature_id"), sign.alias("sign"))
    signed = markers.select(F.max(F.when(sign != "", 1).otherwise(0)).alias("any_sign"))
    out = parsed.crossJoin(F.broadcast(signed)).where("any_sign = 0 or sign != ''")  # one row on the right
    return out.select("celltype", "feature_id", F.when(F.col("sign") == "-", -1).otherwise(1).alias("direction"))


def normalize_labels(labels: DataFrame, column: str = "label_name") -> DataFrame:
    """(cell_id, label, label_name): codes 1..K in the order of names; false and true become No and Yes.
    Null labels stay null."""
    name = F.col(column)
    if dict(labels.dtypes)[column] == "boolean":
        name = F.when(name, "Yes").when(~name, "No")
    named = labels.select("cell_id", name.cast("string").alias("label_name"))
    codes = named.where("label_name is not null").select("label_name").distinct()
    codes = codes.withColumn("label", F.row_number().over(Window.orderBy("label_name")).cast("int"))
    return named.join(F.broadcast(codes), "label_name", "left").select("cell_id", "label", "label_name")


def recode_labels(labels: DataFrame) -> DataFrame:
    """Labels recoded to 1..K in the order of their codes."""
    codes = labels.where("label is not null").select("label").distinct()
    codes = codes.withColumn("__new", F.row_number().over(Window.orderBy("label")).cast("int"))
    return labels.join(F.broadcast(codes), "label", "left").withColumn("label", F.col("__new")).drop("__new").select(*labels.columns)


def archetype_names(selected: DataFrame, k_min: int = 2) -> DataFrame:
    """``selected(k, arch)`` with the name A<i>_<j>, i counting depths from 1."""
    return selected.withColumn("name", F.concat(F.lit("A"), F.col("k") - k_min + 1, F.lit("_"), F.col("arch")))


def one_hot(batches: DataFrame, column: str = "batch") -> DataFrame:
    """(cell_id, level, value): a one for each cell's level."""
    return batches.where(F.col(column).isNotNull()).select("cell_id", F.col(column).alias("level"), F.lit(1.0).alias("value"))


def supported_archetypes(c_matrix: DataFrame, least: int = 5) -> DataFrame:
    """Archetypes to which at least ``least`` cells contribute."""
    return c_matrix.where("value > 0").groupBy("arch").agg(F.count("*").alias("cells")).where(F.col("cells") >= least).select("arch")


def remove_cells(frames: dict[str, DataFrame], cells: DataFrame, renormalize: tuple[str, ...] = ("c_matrix",)) -> dict[str, DataFrame]:
    """Every frame with a cell_id without these cells, graphs (src, dst) as induced subgraphs; the
    columns of C, by arch, sum to one again."""
    gone = cells.select("cell_id").distinct()
    out = {}
    for name, df in frames.items():
        if "cell_id" in df.columns:
            df = df.join(gone, "cell_id", "left_anti")
        elif {"src", "dst"} <= set(df.columns):
            df = df.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti")
        if name in renormalize:
            w = Window.partitionBy(*[c for c in ("k", "arch") if c in df.columns])
            total = F.sum("value").over(w)
            df = df.withColumn("value", F.col("value") / F.when(total > 0, total))
        out[name] = df
    return out
