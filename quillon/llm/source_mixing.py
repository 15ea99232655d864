"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A document's expected copies are its source's target / size, more for
short documents and fewer for long ones by a slope that leaves the source's words as they are. The whole
part is certain; the rest is its probability in a sample without replacement. Pareto sampling ranks
documents by random odds divided by inclusion odds, (u / (1-u)) / (p / (1-p)), and takes the smallest;
here the sample's fixed size is counted in words.

Words are summed by source and bin of the ranking value before anything is ordered, so only the bin in
which a source's target falls is sorted, without texts. What comes out is one row for each source with
the last rank that is taken; documents meet it in a broadcast join and are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.tables import materialize

#: Weights of sources in code-point order, repeated; share of all words that the mix has; copies at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BINS = 4096
#: Words from which a document is of the next class of length; share of the room, between no copy and
#: MOST, that lies between the expected copies of the first class and of the last.
LENGTHS, SLOPE = (50, 200, 800, 3200), 0.25
#: A table of more sources is joined by a shuffle.
BROADCAST_SOURCES = 20_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[tuple[str | None, int, float]]:
    """(source, words, target): the share of all words by weight, none above ``most`` times its size,
    what is over shared again by weight."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [float(weights[i % len(weights)]) for i in range(len(ordered))]
    left = share * sum(n for _, n in ordered)
    target, open_ = [0.0] * len(ordered), [i for i, (_, n) in enumerate(ordered) if n > 0]
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] / total > most * ordered[i][1]]
        if not over:
            for i in open_:
                target[i] = left * weight[i] / total
            break
        for i in over:
            target[i] = float(most * ordered[i][1])
            left -= target[i]
        open_ = [i for i in open_ if i not in over]
    return [(s, n, t) for (s, n), t in zip(ordered, target, strict=True)]


def length_class(size: Column) -> Column:
    return sum((F.when(size >= n, 1).otherwise(0) for n in LENGTHS), F.lit(0))


def expected(words: list[int], target: float, most: float = MOST) -> list[float]:
    """Expected copies of a source's documents by class of length; words: those of each class. Their
    words sum to ``target``."""
    total = sum(words)
    if not total:
        return [0.0] * len(words)
    ratio = target / total
    mean = sum(c * n for c, n in enumerate(words)) / total
    slope = SLOPE * min(ratio, most - ratio) / len(LENGTHS)
    return [ratio + slope * (mean - c) for c in range(len(words))]


_GOAL = "source string, source_size long, target double, whole array<long>, share array<double>, rest double"


def targets(sized: DataFrame) -> tuple[DataFrame, bool]:
    """(the goal of each source, whether they are few): its size and target, certain copies and the rest's
    probability by class of length, and the words that the sample takes. The table of sources is small next
    to any corpus and is filled on the driver; documents never go there."""
    classes = range(len(LENGTHS) + 1)
    rows = sized.groupBy("source").agg(*(F.sum(F.when(F.col("class") == c, F.col("size")).otherwise(0)).alias(f"n{c}") for c in classes)).collect()
    words = {r["source"]: [int(r[f"n{c}"]) for c in classes] for r in rows}
    out = []
    for source, n, target in water_fill([(source, sum(w)) for source, w in words.items()]):
        copies = expected(words[source], target)
        whole = [int(x + 1e-12) for x in copies]
        share = [max(0.0, x - k) for x, k in zip(copies, whole, strict=True)]
        out.append((source, n, target, whole, share, target - sum(k * w for k, w in zip(whole, words[source], strict=True))))
    return sized.sparkSession.createDataFrame(out, _GOAL), len(out) <= BROADCAST_SOURCES


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of a text: the same in any engine and on every run."""
    text = F.concat_ws("|", F.lit(SEED), *parts)
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def _sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, class, u) of each document."""
    doc_id, size = F.col("doc_id").cast("long"), word_count(F.col("text"))
    out = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    return out.withColumn("class", length_class(F.col("size"))).withColumn("u", _uniform(F.col("doc_id").cast("string")))


def _ranked(sized: DataFrame, goal: DataFrame, few: bool) -> DataFrame:
    """``sized`` with its source's goal, its certain copies, and the rank and bin of the rest."""
    names = [c for c in sized.columns if c != "source"]
    joined = sized.join(F.broadcast(goal) if few else goal, sized["source"].eqNullSafe(goal["source"]))
    joined = joined.select(*names, sized["source"], *(goal[c] for c in goal.columns if c not in ("source", "whole", "share")), goal["whole"][F.col("class")].alias("whole"), goal["share"][F.col("class")].alias("share"))
    share = F.col("share")
    rank = F.col("u") / (1 - F.col("u")) / (share / (1 - share))
    ranked = joined.withColumn("rank", F.when((share > 1e-12) & (F.col("size") > 0), rank))
    return ranked.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("rank") / (1 + F.col("rank")) * BINS)).cast("int"))


def _plan(sized: DataFrame) -> tuple[DataFrame, bool]:
    """The goals with the bin in which each sample ends (null: it takes all) and the last that it takes there."""
    goal, few = targets(sized)
    ranked = _ranked(sized, goal, few)
    bins = ranked.where("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("room"))
    upto = Window.partitionBy("source").orderBy("bin")
    ends = bins.withColumn("upto", F.sum("words").over(upto)).where("upto > room").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
    ends = ends.select(F.col("source").alias("of"), F.col("end.bin").alias("edge"), F.col("end.before").alias("before"))
    ends = F.broadcast(ends) if few else ends
    edge = ranked.join(ends, ranked["source"].eqNullSafe(ends["of"]) & (ranked["bin"] == ends["edge"]))
    ahead = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("size").over(ahead), F.lit(0))
    taken = edge.select("source", "edge", "rest", "size", at.alias("at"), F.struct("rank", "doc_id", "size").alias("place"))
    last = taken.groupBy("source").agg(F.min("edge").alias("edge"), F.max(F.when(F.col("at") + F.col("size") / 2 <= F.col("rest"), F.col("place"))).alias("last"))
    last = last.withColumnRenamed("source", "of")
    plan = goal.join(last, goal["source"].eqNullSafe(last["of"]), "left").drop("of")
    return materialize(plan, "mix-plan"), few


def _copies() -> Column:
    """How often a ranked document is taken, by the plan's columns."""
    edge, place = F.col("edge"), F.struct("rank", "doc_id", "size")
    taken = F.when(F.col("bin").isNull(), 0).when(edge.isNull() | (F.col("bin") < edge), 1).when((F.col("bin") == edge) & (place <= F.col("last")), 1).otherwise(0)
    return F.when(F.col("size") > 0, F.col("whole") + taken).otherwise(F.lit(0)).cast("int")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): one row per row of ``docs``.

    Size counts the words ``[^\\x20\\x09-\\x0D]+``; null text has none. A null source is a source of its
    own, the last. Equal rankings are ordered by id, a null id first, then size; rows of one source that
    are equal in id and size are taken alike. Documents without words, and sources without words, take
    nothing. A source that reaches its cap takes every document that often. Other columns are ignored; an
    empty table gives an empty result.
    """
    sized = materialize(_sized(docs), "mix-sizes")
    out = _ranked(sized, *_plan(sized)).withColumn("copies", _copies())
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def repeat(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns. Rows without words
    are not taken; those without an id are, by their size, like any others. An empty table stays empty."""
    plan = _plan(materialize(_sized(docs), "mix-sizes"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    sized = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sized = sized.withColumn("class", length_class(F.col("size"))).withColumn("u", _uniform(F.col("doc_id").cast("string")))
    taken = _ranked(sized, *plan).withColumn("copies", _copies()).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), base AS (
  SELECT source, sum(size)::BIGINT AS n,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source
), fill AS (
  -- shares rise with n/w: the sources with the least room reach their caps first
  SELECT *, sum(2.0 * n) OVER o - 2.0 * n AS capped, sum(w) OVER (ORDER BY n / w DESC, source DESC) AS open_w,
         1.5 * sum(n) OVER () AS total
  FROM base WHERE n > 0 WINDOW o AS (ORDER BY n / w, source)
), level AS (
  SELECT arg_min((total - capped) / open_w, (n / w, source)) FILTER (WHERE (total - capped) / open_w * w <= 2.0 * n) AS lambda FROM fill
), goal AS (
  SELECT b.source, b.n, CASE WHEN b.n = 0 THEN 0.0 ELSE least(2.0 * b.n, coalesce(l.lambda, 1e300) * b.w) END AS target FROM base b, level l
), sloped AS (
  SELECT s.doc_id, s.source, s.size, g.n AS source_size, g.target,
         (s.size >= 50)::INT + (s.size >= 200)::INT + (s.size >= 800)::INT + (s.size >= 3200)::INT AS class,
         (('0x' || substr(md5('mix-1|' || s.doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), placed AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size
                  + 0.25 * least(target / source_size, 2 - target / source_size) / 4
                  * (sum(class * size) OVER (PARTITION BY source)::DOUBLE / source_size - class) ELSE 0 END AS expected
  FROM sloped
), ranked AS (
  SELECT *, floor(expected + 1e-12) AS whole, target - sum(floor(expected + 1e-12) * size) OVER (PARTITION BY source) AS rest,
         CASE WHEN expected - floor(expected + 1e-12) > 1e-12 AND size > 0 THEN (u / (1 - u)) / ((expected - floor(expected + 1e-12)) / (1 - (expected - floor(expected + 1e-12)))) END AS rank
  FROM placed
), summed AS (
  SELECT *, coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM ranked
), counted AS (
  SELECT *, CASE WHEN size > 0 THEN whole + CASE WHEN rank IS NOT NULL AND ahead + size / 2.0 <= rest THEN 1 ELSE 0 END ELSE 0 END AS copies
  FROM summed
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::INT AS copies FROM counted
"""
