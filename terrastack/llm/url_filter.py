"""URL filters with a memory: what a list said on the day a page was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrastack.llm.staging import fits, staged, unused

#: Parts that a list key too long to broadcast is dealt in, against keys that very many URLs share.
SALT = 16

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    """Lower-cased host, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def path(url: Column) -> Column:
    """The path from its first slash; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def keys(url: Column, labels: int, segments: int) -> Column:
    """All that a list entry may name: each domain the host lies in, alone and with each prefix of the path.

    Only domains of up to ``labels`` labels and prefixes of up to ``segments`` segments: those of the list's own entries.
    """
    names, steps = F.split(host(url), r"\."), F.split(path(url), "/")
    first = F.greatest(F.size(names) - (labels - 1), F.lit(1))
    domains = F.transform(F.sequence(first, F.size(names)), lambda i: F.slice(names, i, F.size(names)))
    domains = F.transform(F.filter(domains, lambda d: d[0] != ""), lambda d: F.array_join(d, "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(segments))), lambda j: F.slice(steps, F.lit(1), j + 1))
    prefixes = F.transform(F.filter(prefixes, lambda p: (F.size(p) == 1) | (F.element_at(p, -1) != "")), lambda p: F.array_join(p, "/"))
    return F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p))))


def validity(entries: DataFrame) -> DataFrame:
    """``(key, spans)``: for each key the days [from, to) on which an entry blocks it.

    ``entries(key, day, action)``: an entry holds from its day until the key's next one; of entries of one day the last
    action by code point holds (so ``unblock`` beats ``block``). Entries without key or day are left out.
    """
    one = entries.where("key is not null and day is not null").groupBy("key", "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    spans = one.withColumn("until", F.coalesce(until, F.lit("9999-12-31").cast("date"))).where("action = 'block'")
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("day", "until"))).alias("spans"))


def filtered(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures(.., url, fetched)`` with ``n_active`` (keys blocked on the day of fetching) and ``blocked``.

    An as-of join of every capture with the list. An entry names a domain, which holds for all hosts in it, or a domain
    and the first segments of a path, however many. Keys are looked up for each distinct URL, so a URL or host that a
    third of all captures share is one probe, and what a URL hits comes back to its captures as one row. A list beyond
    what may be broadcast is joined by shuffle, only by the keys that occur, each dealt in parts. Null URLs and
    null days are never blocked; repeated rows are judged alike; a very long URL has no more keys than the list's longest
    entry asks for; empty tables are fine, also an empty list. Columns of ``captures`` named ``n_active`` or ``blocked``
    are replaced.
    """
    spans = staged(validity(entries), "validity")
    domain = F.substring_index("key", "/", 1)
    longest = spans.agg(F.max(F.size(F.split(domain, r"\."))), F.max(F.size(F.split("key", "/")) - 1)).first()
    urls = captures.select("url").where("url is not null").distinct()
    probes = urls.select("url", F.explode(F.array_distinct(keys(F.col("url"), longest[0] or 1, longest[1] or 0))).alias("key"))
    if fits(spans):
        met = probes.join(F.broadcast(spans), "key")
    else:
        known = staged(probes.select("key").distinct().join(spans, "key"), "known")
        dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = probes.join(F.broadcast(known), "key") if fits(known) else probes.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALT)).cast("int")).join(dealt, ["key", "salt"])
    out = captures.drop("n_active", "blocked")
    found, same = unused(out.columns, "spans"), unused(out.columns, "same_url")
    hits = staged(met.groupBy("url").agg(F.collect_list("spans").alias(found)).withColumnRenamed("url", same), "hits")
    joined = out.join(F.broadcast(hits) if fits(hits) else hits, F.col("url") == F.col(same), "left")
    active = F.filter(found, lambda key: F.exists(key, lambda s: (s["day"] <= F.col("fetched")) & (F.col("fetched") < s["until"])))
    n = F.when(F.col("fetched").isNotNull() & F.col(found).isNotNull(), F.size(active)).otherwise(0).cast("long")
    return joined.select(*(out[c] for c in out.columns), n.alias("n_active"), (n > 0).alias("blocked"))


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list made from the md5 of each host of ``pages``, as the tables hold none: of hosts, of the domains above
    them, and of hosts with one or two segments of a path."""
    url = F.col("url")
    steps = F.split(path(url), "/")
    one = F.when(F.size(steps) > 1, F.concat(host(url), F.lit("/"), steps[1]))
    two = F.when(F.size(steps) > 2, F.concat(host(url), F.lit("/"), steps[1], F.lit("/"), steps[2]))
    hosts = pages.select(host(url).alias("host"), one.alias("one"), two.alias("two")).where("host <> ''").groupBy("host").agg(F.min("one").alias("one"), F.min("two").alias("two")).withColumn("m", F.md5("host"))
    number = lambda a, n: F.conv(F.substring("m", a, n), 16, 10).cast("int")
    form = number(13, 2) % 4
    key = F.when(form == 1, F.regexp_replace("host", r"^[^.]*\.", "")).when(form == 2, F.coalesce("one", "host")).when(form == 3, F.coalesce("two", "host")).otherwise(F.col("host"))
    start = F.date_add(F.lit("2024-01-01").cast("date"), number(1, 4) % 300)
    blocked = hosts.select(key.alias("key"), "m").withColumn("start", start).where(number(5, 2) % 3 == 0)
    lifted = blocked.where(number(7, 2) % 2 == 0)
    again = lifted.where(number(9, 2) % 2 == 0)
    return (
        blocked.select("key", F.col("start").alias("day"), F.lit("block").alias("action"))
        .unionByName(lifted.select("key", F.date_add("start", number(11, 2) % 60 + 1).alias("day"), F.lit("unblock").alias("action")))
        .unionByName(again.select("key", F.date_add("start", number(11, 2) % 60 + 90).alias("day"), F.lit("block").alias("action")))
    )


#: The query over ``pages`` for DuckDB.
SQL = r"""
WITH captures AS (
  SELECT row_number() OVER () AS n, page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS DATE) AS fetched,
         coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
         string_split(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/') AS steps
  FROM pages
), hosts AS (
  SELECT host, md5(host) AS m, min(CASE WHEN len(steps) > 1 THEN host || '/' || steps[2] END) AS one,
         min(CASE WHEN len(steps) > 2 THEN host || '/' || steps[2] || '/' || steps[3] END) AS two FROM captures WHERE host <> '' GROUP BY host
), numbers AS (
  SELECT CASE CAST('0x' || substr(m, 13, 2) AS INTEGER) % 4 WHEN 1 THEN regexp_replace(host, '^[^.]*\.', '') WHEN 2 THEN coalesce(one, host) WHEN 3 THEN coalesce(two, host) ELSE host END AS key,
         CAST('0x' || substr(m, 1, 4) AS INTEGER) % 300 AS a, CAST('0x' || substr(m, 5, 2) AS INTEGER) AS b, CAST('0x' || substr(m, 7, 2) AS INTEGER) AS c,
         CAST('0x' || substr(m, 9, 2) AS INTEGER) AS d, CAST('0x' || substr(m, 11, 2) AS INTEGER) % 60 AS e FROM hosts
), entries AS (
  SELECT key, CAST(DATE '2024-01-01' + a AS DATE) AS day, 'block' AS action FROM numbers WHERE b % 3 = 0
  UNION ALL SELECT key, CAST(DATE '2024-01-01' + a + e + 1 AS DATE), 'unblock' FROM numbers WHERE b % 3 = 0 AND c % 2 = 0
  UNION ALL SELECT key, CAST(DATE '2024-01-01' + a + e + 90 AS DATE), 'block' FROM numbers WHERE b % 3 = 0 AND c % 2 = 0 AND d % 2 = 0
), spans AS (
  SELECT key, day, action, coalesce(lead(day) OVER (PARTITION BY key ORDER BY day), DATE '9999-12-31') AS until
  FROM (SELECT key, day, max(action) AS action FROM entries GROUP BY key, day)
), domains AS (
  SELECT n, fetched, steps, unnest([array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, len(string_split(host, '.')) + 1) IF string_split(host, '.')[i] <> '']) AS domain FROM captures
), probes AS (
  SELECT DISTINCT n, fetched, domain || unnest([array_to_string(steps[1:j + 1], '/') FOR j IN range(0, len(steps)) IF j = 0 OR steps[j + 1] <> '']) AS key FROM domains
), hits AS (
  SELECT n, count(DISTINCT p.key) AS n_active FROM probes p JOIN spans s ON s.key = p.key AND s.action = 'block' AND s.day <= p.fetched AND p.fetched < s.until GROUP BY n
)
SELECT page_id, url, fetched, CAST(coalesce(n_active, 0) AS BIGINT) AS n_active, coalesce(n_active, 0) > 0 AS blocked FROM captures LEFT JOIN hits USING (n)
"""
