"""URL filtering against dated lists by an as-of join.

List changes (an entry is added or removed on a day) become the validity
intervals of each entry.  Every capture is then judged by the entries that were
in force when it was fetched, not by today's list.

An entry is a host (it covers its subdomains) or a host with the beginning of a
path (it covers whole path segments).  A capture's URL names few keys that
could be entries: its host, the host's parents and the path's beginnings.  One
equi-join on the key meets the entry's intervals, at most one row an entry, so
a host with a third of all captures only makes a large side that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Host in lower case without a leading ``www.`` or a final dot; null if the text is no absolute URL."""
    h = F.regexp_extract(F.lower(F.regexp_substr(F.trim(url), F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^?#/]*"))), URL, 1)
    h = F.regexp_replace(F.regexp_replace(h, r"^www\.", ""), r"\.$", "")
    return F.nullif(h, F.lit(""))


def path(url: Column) -> Column:
    """Path without its final slashes; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), r"/+$", "")


def intervals(changes: DataFrame) -> DataFrame:
    """``entry, spans`` from ``entry, day, action``: the days ``[since, until)`` on which an entry is in force.

    Actions are ``add`` and ``remove``; others, and rows with a null, are
    ignored.  Of changes of one entry on one day an ``add`` wins.  Adding twice
    or removing what isn't there changes nothing; a last ``add`` has no end."""
    e = F.lower(F.trim("entry"))
    steps = changes.where("entry is not null and day is not null and action in ('add', 'remove')").groupBy(F.regexp_replace(e, r"^www\.|/+$", "").alias("entry"), "day").agg(
        F.max((F.col("action") == "add").cast("int")).alias("on"))
    line = steps.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("day", "on"))).alias("line"))
    turns = F.filter("line", lambda s, i: s.on != F.when(i == 0, F.lit(0)).otherwise(F.get("line", i - 1).on))
    line = line.withColumn("turns", turns)
    spans = F.transform(F.filter("turns", lambda s: s.on == 1), lambda s: F.struct(s.day.alias("since"), F.get(F.filter("turns", lambda t: (t.on == 0) & (t.day > s.day)), F.lit(0)).day.alias("until")))
    return line.select("entry", spans.alias("spans")).where("size(spans) > 0")


def keys(url: Column) -> Column:
    """All entries that would cover a URL: host, parents of at least two labels, and the host with each beginning of the path."""
    labels = F.split(host(url), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split(path(url), "/")
    paths = F.transform(F.when(F.size(steps) > 1, F.sequence(F.lit(2), F.size(steps))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(host(url), F.lower(F.array_join(F.slice(steps, 1, i), "/"))))
    return F.when(host(url).isNotNull(), F.array_distinct(F.concat(parents, paths))).otherwise(F.array().cast("array<string>"))


def evaluate(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """Judge every capture by the list as it stood on the day of its fetch.

    Returns one row per capture: ``page_id, url, host, fetch_day, blocked, entry,
    since, until``; the entry is the longest in force (then the first by code
    point), nulls where none is.  Captures with a null URL or day, or with no
    host, are not blocked.  Repeated captures are judged alike and returned
    each; empty captures or lists and further columns are fine.
    """
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(day_col).cast("int").alias("fetch_day"))
    asked = rows.where("url is not null and fetch_day is not null").select("page_id", "url", "fetch_day", F.explode(keys(F.col("url"))).alias("entry"))
    span = F.get(F.filter("spans", lambda s: (s.since <= F.col("fetch_day")) & (s.until.isNull() | (s.until > F.col("fetch_day")))), F.lit(0))
    hits = asked.join(intervals(changes), "entry").withColumn("span", span).where("span is not null")
    worst = hits.groupBy("page_id", "url", "fetch_day").agg(F.min(F.struct((-F.length("entry")).alias("n"), "entry", "span")).alias("w"))
    worst = worst.select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("fetch_day").alias("d"), "w")
    out = rows.join(worst, rows.page_id.eqNullSafe(F.col("p")) & (rows.url == F.col("u")) & (rows.fetch_day == F.col("d")), "left")
    return out.select("page_id", "url", host(F.col("url")).alias("host"), "fetch_day", F.col("w").isNotNull().alias("blocked"), F.col("w.entry").alias("entry"),
                      F.col("w.span.since").alias("since"), F.col("w.span.until").alias("until"))


def number(text: Column) -> Column:
    """A whole number drawn from a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("int")


def drawn_changes(pages: DataFrame) -> DataFrame:
    """A dated list over a third of the hosts of a table of pages, drawn from the hosts' names.

    The tables have none of their own.  Every such host is added once; half of
    these are removed later, and half of those added again."""
    h = pages.select(host(F.col("url")).alias("entry")).where("entry is not null").distinct().withColumn("n", number(F.col("entry"))).where("n % 3 = 0")
    change = lambda action, day: F.struct(F.lit(action).alias("action"), day.cast("int").alias("day"))
    first = F.col("n") % 200
    made = F.concat(F.array(change("add", first)), F.when(F.col("n") % 2 == 0, F.array(change("remove", first + 60))).otherwise(F.array().cast("array<struct<action:string,day:int>>")),
                    F.when(F.col("n") % 4 == 0, F.array(change("add", first + 120))).otherwise(F.array().cast("array<struct<action:string,day:int>>")))
    return h.select("entry", F.explode(made).alias("c")).select("entry", "c.day", "c.action")


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, CAST(('0x' || substr(md5(url), 1, 7)) AS INTEGER) % 365 AS fetch_day,
         nullif(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '^www\.', ''), '\.$', ''), '') AS host,
         regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/+$', '') AS path
  FROM pages),
h AS (SELECT host, CAST(('0x' || substr(md5(host), 1, 7)) AS INTEGER) AS n FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)),
l AS (
  SELECT host AS entry, n % 200 AS since, CASE WHEN n % 2 = 0 THEN n % 200 + 60 END AS until FROM h WHERE n % 3 = 0
  UNION ALL SELECT host, n % 200 + 120, NULL FROM h WHERE n % 3 = 0 AND n % 4 = 0),
k AS (
  SELECT DISTINCT page_id, url, fetch_day, unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'))) AS entry
  FROM p WHERE host IS NOT NULL),
m AS (
  SELECT k.page_id, k.url, k.fetch_day, l.*, row_number() OVER (PARTITION BY k.page_id, k.url, k.fetch_day ORDER BY length(l.entry) DESC, l.entry) AS rn
  FROM k JOIN l ON k.entry = l.entry AND l.since <= k.fetch_day AND (l.until IS NULL OR l.until > k.fetch_day))
SELECT p.page_id, p.url, p.host, p.fetch_day, m.entry IS NOT NULL AS blocked, m.entry, m.since, m.until
FROM p LEFT JOIN m ON m.rn = 1 AND p.page_id IS NOT DISTINCT FROM m.page_id AND p.url = m.url AND p.fetch_day = m.fetch_day
"""
