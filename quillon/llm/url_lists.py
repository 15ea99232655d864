"""URL filtering by a temporal list join.

Dated list entries (``add`` or ``remove`` of a key) become validity intervals; an as-of join evaluates
every capture against the entries that were active when it was fetched. A key is a host, which also
covers its subdomains, or a host with a first path segment. The join is an equi-join on keys with the
time as a condition, so it needs no cross join, and each distinct (URL, time) is evaluated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def url_keys(url: Column) -> Column:
    """The keys that can match a URL: its host, each parent domain, and host/first-segment."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    labels = F.split(host, "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.lower(F.regexp_extract(url, SEGMENT, 1))
    path = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(suffixes, path)).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """(list, key, from_day, to_day) from ``entries(list, key, action, day)``: an ``add`` holds until the
    next entry of its list and key. Of entries of one day a removal is the last. Null keys, lists,
    actions or days are ignored."""
    order = Window.partitionBy("list", "key").orderBy("day", "action")
    clean = entries.where("list is not null and key is not null and action is not null and day is not null").distinct()
    return clean.withColumn("to_day", F.lead("day").over(order)).where("action = 'add'").select("list", "key", F.col("day").alias("from_day"), "to_day").where("to_day is null or to_day > from_day")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """``captures`` with ``blocked`` boolean, ``n_active`` long (active entries that match), ``lists`` and
    ``rules`` string (their lists and keys, sorted), which replace columns of these names.

    A capture with a null or unreadable URL, or a null time, matches nothing. Repeated captures each get
    their row. Without entries nothing is blocked.
    """
    kept = captures.drop("blocked", "n_active", "lists", "rules")
    asked = kept.select(F.col(url).alias("__u"), F.col(day).alias("__d")).where("__u is not null and __d is not null").distinct()
    keyed = asked.withColumn("key", F.explode(F.array_distinct(url_keys(F.col("__u")))))
    active = keyed.join(validity(entries), "key").where("__d >= from_day and (to_day is null or __d < to_day)")
    found = active.groupBy("__u", "__d").agg(
        F.count("*").alias("__n"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("__lists"), F.array_join(F.array_sort(F.collect_set("key")), ",").alias("__rules")
    )
    joined = kept.join(found, (kept[url] == found["__u"]) & (kept[day] == found["__d"]), "left")
    n, none = F.coalesce("__n", F.lit(0)), F.lit("")
    return joined.select(*[kept[c] for c in kept.columns], (n > 0).alias("blocked"), n.alias("n_active"), F.coalesce("__lists", none).alias("lists"), F.coalesce("__rules", none).alias("rules"))


def _draw(key: Column, start: int, size: int, modulus: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(key), start, size), 16, 10).cast("long"), F.lit(modulus))


def demo_entries(pages: DataFrame) -> DataFrame:
    """A dated list made by rule from the hosts and first segments of ``pages``, since the tables have
    none: a third of hosts are added on some day of 2 years, half of these removed later and some added
    again; so are some sections."""
    host, segment = F.lower(F.regexp_extract("url", HOST, 1)), F.lower(F.regexp_extract("url", SEGMENT, 1))
    hosts = pages.select(F.lit("hosts").alias("list"), host.alias("key")).where("key != ''")
    sections = pages.select(F.lit("sections").alias("list"), F.concat(host, F.lit("/"), segment).alias("key")).where(segment != "")
    keys = hosts.union(sections).distinct()
    drawn = keys.where(_draw(F.col("key"), 1, 4, 3) == 0).withColumn("day", _draw(F.col("key"), 5, 4, 700)).withColumn("gap", 1 + _draw(F.col("key"), 9, 4, 200))
    added = drawn.select("list", "key", F.lit("add").alias("action"), "day")
    removed = drawn.where(_draw(F.col("key"), 13, 4, 2) == 0).select("list", "key", F.lit("remove").alias("action"), (F.col("day") + F.col("gap")).alias("day"))
    again = drawn.where(_draw(F.col("key"), 13, 4, 4) == 0).select("list", "key", F.lit("add").alias("action"), (F.col("day") + 2 * F.col("gap")).alias("day"))
    return added.union(removed).union(again)


def filter_pages(pages: DataFrame) -> DataFrame:
    """(page_id, fetch_day, blocked, n_active, lists, rules) of each row of ``pages``, taken to be fetched
    on day page_id modulo 731."""
    captures = pages.select("page_id", "url", F.pmod("page_id", F.lit(731)).alias("fetch_day"))
    return evaluate(captures, demo_entries(pages)).select("page_id", "fetch_day", "blocked", "n_active", "lists", "rules")


FILTER_SQL = r"""
WITH p AS (
  SELECT page_id, url, page_id % 731 AS fetch_day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1)) AS segment
  FROM pages
), keys AS (
  SELECT 'hosts' AS list, host AS key FROM p WHERE host != '' UNION
  SELECT 'sections', host || '/' || segment FROM p WHERE segment != ''
), drawn AS (
  SELECT *, ('0x' || substr(md5(key), 5, 4))::BIGINT % 700 AS day, 1 + ('0x' || substr(md5(key), 9, 4))::BIGINT % 200 AS gap,
         ('0x' || substr(md5(key), 13, 4))::BIGINT AS r
  FROM keys WHERE ('0x' || substr(md5(key), 1, 4))::BIGINT % 3 = 0
), entries AS (
  SELECT list, key, 'add' AS action, day FROM drawn UNION ALL
  SELECT list, key, 'remove', day + gap FROM drawn WHERE r % 2 = 0 UNION ALL
  SELECT list, key, 'add', day + 2 * gap FROM drawn WHERE r % 4 = 0
), spans AS (
  SELECT *, lead(day) OVER (PARTITION BY list, key ORDER BY day, action) AS to_day FROM (SELECT DISTINCT * FROM entries)
), asked AS (SELECT DISTINCT url, fetch_day, host, segment FROM p WHERE url IS NOT NULL AND host != ''),
labels AS (SELECT *, string_split(host, '.') AS l FROM asked),
keyed AS (
  SELECT url, fetch_day, unnest([array_to_string(l[i:], '.') FOR i IN range(1, len(l) + 1)]) AS key FROM labels
  UNION SELECT url, fetch_day, host || '/' || segment FROM asked WHERE segment != ''
), found AS (
  SELECT k.url, k.fetch_day, count(*) AS n, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, array_to_string(list_sort(list(DISTINCT key)), ',') AS rules
  FROM keyed k JOIN spans s USING (key)
  WHERE s.action = 'add' AND k.fetch_day >= s.day AND (s.to_day IS NULL OR k.fetch_day < s.to_day) GROUP BY ALL
)
SELECT page_id, p.fetch_day, coalesce(n, 0) > 0 AS blocked, coalesce(n, 0)::BIGINT AS n_active, coalesce(lists, '') AS lists, coalesce(rules, '') AS rules
FROM p LEFT JOIN found f ON p.url = f.url AND p.fetch_day = f.fetch_day
"""
