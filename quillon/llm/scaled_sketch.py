"""Document fingerprints by a threshold-scaled sketch, in DataFrame expressions only.

A fingerprint holds every distinct shingle hash below a fixed fraction of the hash range, so the
sketches of two texts, however unequal in length, are samples by the same rule: their union is the
sketch of both together, and shared hashes estimate containment and likeness without bias. A text
whose shingles all miss the fraction keeps its smallest hash, so only a text without words has none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.tables import materialize

WIDTH, FRACTION = 5, 8
#: Hashes are signed; those below this value are one in FRACTION.
THRESHOLD = -(2**63) + 2**64 // FRACTION
CELLS, ROWS = 200, 1000


def shingle_hashes(words: Column) -> Column:
    """Hashes of shingles of WIDTH words from hashed ``words``; a shorter text is one shingle."""
    n = F.size(words)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - (WIDTH - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, WIDTH)))
    )


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the sorted hashes of its column ``text`` in ``out``. Words are runs of
    ``[^\\x20\\x09-\\x0D]``, as they stand. The steps are columns of their own so that each is
    computed once a row."""
    w, s = f"__{out}_words", f"__{out}_all"
    df = df.withColumn(w, F.transform(F.regexp_extract_all(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), lambda x: F.xxhash64(x)))
    df = df.withColumn(s, shingle_hashes(F.col(w)))
    low = F.array_sort(F.array_distinct(F.filter(F.col(s), lambda x: x < F.lit(THRESHOLD))))
    df = df.withColumn(out, low)
    least = F.when(F.size(s) > 0, F.array(F.array_min(s))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(least)).drop(w, s)


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two texts from their sketches; two without words are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def containment(a: str, b: str) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def merge(a: str, b: str) -> Column:
    """The sketch of two texts together."""
    return F.array_sort(F.array_union(a, b))


def as_text(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.hex(x))), ",")


def _branch(key: Column, bounds: list[int], of, lo: int, hi: int) -> Column:
    """A decision tree over sorted bounds: ``of(i)`` for the cell i that holds ``key``."""
    if lo == hi:
        return of(lo)
    mid = (lo + hi + 1) // 2
    return F.when(key < F.lit(bounds[mid]), _branch(key, bounds, of, lo, mid - 1)).otherwise(_branch(key, bounds, of, mid, hi))


def _placing(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Adds ``cell`` and ``slot``, which follow the order of ``k`` and hold few rows each: cells between
    quantiles of ``df``, cut into slots of equal width."""
    n = df.count()
    probs = [i / CELLS for i in range(CELLS + 1)]
    quantiles = df.select(F.percentile_approx("k", probs, 10_000)).first()[0] if n else None
    bounds = sorted(set(quantiles or [0]))
    slots = max(1, n // (ROWS * CELLS))
    top = len(bounds) - 1

    def slot(i: int) -> Column:
        if i == top or slots == 1:
            return F.lit(0).cast("long")
        low, high = float(bounds[i]), float(bounds[i + 1])
        return F.least(F.lit(slots - 1), F.greatest(F.lit(0), F.floor((F.col("k").cast("double") - low) / max(high - low, 1.0) * slots)))

    cell = _branch(F.col("k"), bounds, lambda i: F.lit(i), 0, top)
    return lambda rows: rows.withColumn("cell", cell).withColumn("slot", _branch(F.col("k"), bounds, slot, 0, top))


def _with_next(docs: DataFrame) -> DataFrame:
    """``docs(k, text, sketch)`` with ``next``, the text and sketch of the row after it by descending k,
    and after the last the first. Each slot is ordered alone; the first row of the slot after it joins
    it as a guest, so a text is shuffled once and no task holds more than a slot."""
    place = _placing(docs.select("k"))
    firsts = place(docs.select("k")).groupBy("cell", "slot").agg(F.max("k").alias("top"))
    down = Window.partitionBy("cell").orderBy(F.desc("slot"))
    inner = firsts.withColumn("guest", F.lead("top").over(down))
    cells = firsts.groupBy("cell").agg(F.max("top").alias("cell_top"))  # CELLS rows at most
    order = Window.orderBy(F.desc("cell"))
    cells = cells.withColumn("after", F.coalesce(F.lead("cell_top").over(order), F.first("cell_top").over(order))).select("cell", "after")
    guests = materialize(inner.join(cells, "cell").select(F.coalesce("guest", "after").alias("k"), "cell", "slot"), "sketch-guests")
    rows = place(docs).withColumn("guest", F.lit(0))
    invited = docs.join(guests, "k").withColumn("guest", F.lit(1))
    both = rows.unionByName(invited)
    line = Window.partitionBy("cell", "slot").orderBy("guest", F.desc("k"), F.xxhash64("text"))
    return both.withColumn("next", F.lead(F.struct("text", "sketch")).over(line)).where("guest = 0")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    held_in_next): one row per row of ``docs``.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all,
    of the next document by descending id; after the last comes the first. Null text is empty. A null
    id counts as the smallest. Rows with one id follow one another in the order of a hash of their
    text. ``held_in_next`` is the containment in the next document. Other columns are ignored; an empty
    table gives an empty result.
    """
    lowest = F.lit(-(2**63)).cast("long")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    ready = with_sketch(base, "text", "sketch")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = _with_next(ready).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    done = with_sketch(rows, "edited", "edited_sketch")
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"), containment("sketch", "next_sketch").alias("held_in_next"),
    )
