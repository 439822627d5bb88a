"""URL filters by a temporal list join, in DataFrame operations only.

A list is dated events: an entry (a domain, or a domain with a path prefix) is
added to or removed from a named list at a time. The events of an entry become
validity intervals; a capture is held against the entries that were active when
it was fetched. An entry holds for its domain and all subdomains, and for paths
under its prefix by whole segments.

Captures become keys (every parent domain, with every path prefix as deep as any
entry's), which are joined to entries by equality. An entry's intervals travel
as one array, so a capture meets each entry once, and entries are repeated over
``salts`` so that a hot host is spread over tasks.

Defined results: an unparsable or null URL, or a null fetch time, matches
nothing; events of an entry at the same time apply additions first, so removal
wins; repeated events change nothing; repeated captures give repeated results;
an empty list blocks nothing; an empty table gives no rows; very long URLs are
taken whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import table

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\[\]]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without port, user and final dot; null if there is none."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, AUTHORITY, 1), r"\.+$", ""))
    return F.when(host != "", host)


def segments_of(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")


def intervals(events: DataFrame) -> DataFrame:
    """key, spans (list, since, until) from events (list, entry, action, at)."""
    clean = events.select(
        "list", F.lower(F.regexp_replace("entry", r"/+$", "")).alias("key"), "action", F.col("at").alias("since")
    ).dropna()
    order = Window.partitionBy("list", "key").orderBy("since", F.col("action") == "remove")
    spans = (
        clean.withColumn("until", F.lead("since").over(order))
        .where((F.col("action") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("since"))))
        .groupBy("key")
        .agg(F.array_sort(F.collect_set(F.struct("list", "since", "until"))).alias("spans"))
    )
    return spans


def match(captures: DataFrame, events: DataFrame, salts: int = 16) -> DataFrame:
    """page_id, host, fetched_at, n_entries, lists, blocked for every capture (page_id, url, fetched_at)."""
    spans = intervals(events)
    depth = F.size(F.split("key", "/")) - 1
    deepest = spans.agg(F.max(depth)).first()[0] or 0
    base = captures.select(
        "page_id", "fetched_at", "url", host_of(F.col("url")).alias("host"), F.slice(segments_of(F.col("url")), 1, max(deepest, 1)).alias("path")
    )
    # Two hashes stand for a capture: one of 64 bits would meet its like among 10^10 captures.
    what = ["page_id", "url", "fetched_at"]
    base = base.withColumn("row", F.xxhash64(*what)).withColumn("also", F.xxhash64(F.lit("also"), *what))
    domains = "transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, 1000000), '.'))"
    prefixes = f"transform(sequence(0, least({deepest}, size(path))), k -> if(k = 0, '', concat('/', lower(array_join(slice(path, 1, greatest(k, 1)), '/')))))"
    keys = F.expr(f"flatten(transform({domains}, d -> transform({prefixes}, p -> concat(d, p))))")
    asked = (
        base.where(F.col("host").isNotNull() & F.col("fetched_at").isNotNull())
        .select("row", "also", "fetched_at", F.explode(keys).alias("key"))
        .withColumn("salt", F.pmod(F.col("row"), F.lit(salts).cast("long")))
    )
    listed = spans.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    live = F.filter(
        "spans",
        lambda s: (s["since"] <= F.col("fetched_at")) & (s["until"].isNull() | (F.col("fetched_at") < s["until"])),
    )
    found = (
        asked.join(listed, ["key", "salt"])
        .select("row", "also", "key", live.alias("live"))
        .where(F.size("live") > 0)
        .groupBy("row", "also")
        .agg(F.collect_set("key").alias("entries"), F.flatten(F.collect_set(F.transform("live", lambda s: s["list"]))).alias("lists"))
    )
    return base.join(found, ["row", "also"], "left").select(
        "page_id", "host", "fetched_at",
        F.coalesce(F.size("entries"), F.lit(0)).cast("long").alias("n_entries"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("lists")), ","), F.lit("")).alias("lists"),
        F.col("entries").isNotNull().alias("blocked"),
    )


def dated_pages(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch time: page_id days after 2024-01-01, modulo 360, stand for it."""
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(pmod(page_id, 360) as int))")
    return pages.select("page_id", "url", at.alias("fetched_at"))


def derived_events(pages: DataFrame) -> DataFrame:
    """The test data has no lists: dated events for hosts of the table, by a rule on c, the first six hex digits of md5(host).

    Hosts with c % 3 = 0 join list ``spam`` on day c % 200, leave it 60 days later
    if c is even, and return after 60 more if it is a multiple of 4. Those with
    c % 3 = 1 have their ``/de`` path on list ``geo`` from day c % 100 for 90 days. Parent domain ``example.org`` is on ``sector`` from
    day 300.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    hosts = hosts.withColumn("c", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long"))
    day = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast({} as int))"
    event = "named_struct('list', '{}', 'entry', {}, 'action', '{}', 'at', {}, 'when', {})"
    e = lambda *a: event.format(*a[:3], day.format(a[3]), a[4])
    events = ", ".join(
        [
            e("spam", "host", "add", "c % 200", "c % 3 = 0"),
            e("spam", "host", "remove", "c % 200 + 60", "c % 3 = 0 and c % 2 = 0"),
            e("spam", "host", "add", "c % 200 + 120", "c % 3 = 0 and c % 4 = 0"),
            e("geo", "concat(host, '/de')", "add", "c % 100", "c % 3 = 1"),
            e("geo", "concat(host, '/de')", "remove", "c % 100 + 90", "c % 3 = 1"),
            e("sector", "'example.org'", "add", "300", "host like '%.example.org'"),
        ]
    )
    rows = hosts.select(F.explode(F.expr(f"filter(array({events}), x -> x.when)")).alias("e"))
    return rows.select("e.list", "e.entry", "e.action", "e.at").distinct()


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return match(dated_pages(pages), derived_events(pages))
