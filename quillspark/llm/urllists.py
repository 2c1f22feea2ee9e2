"""URL filters by dated lists.

Dated additions and removals become validity intervals. Every capture is evaluated as of its fetch
time: an entry counts if its interval holds that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut


def intervals(events: DataFrame) -> DataFrame:
    """Validity intervals (list, entry, since, until) of ``events`` (list, entry, action, at).

    An ``add`` holds from its date, inclusive, until the entry's next event, exclusive; without one
    it holds on (until is null). Adding an entry again changes nothing, nor does removing one that
    isn't there. Of events at the same time a removal comes last. Events with a null list, entry,
    action or date, or another action, are ignored. Entries are matched in lower case.
    """
    known = events.where("list IS NOT NULL AND entry IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')").select("list", F.lower("entry").alias("entry"), "action", "at")
    order = Window.partitionBy("list", "entry").orderBy("at", "action")
    return known.withColumn("until", F.lead("at").over(order)).where("action = 'add' AND (until IS NULL OR until > at)").select("list", "entry", F.col("at").alias("since"), "until")


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and trailing dot; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1), F.lit(""))


def section_of(url: Column) -> Column:
    """First segment of a URL's path in lower case; empty if there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def list_keys(host: Column, section: Column) -> Column:
    """What entries can name: the host, each parent domain, and each of these with the first path segment."""
    parts = F.split(host, r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(section != "", F.concat(names, F.transform(names, lambda n: F.concat(n, F.lit("/"), section)))).otherwise(names)


def evaluate(captures: DataFrame, events: DataFrame, keep: list[str], url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Which lists held each capture when it was fetched.

    Returns ``keep`` of ``captures``, then host, section, lists (names, sorted, comma-joined, empty
    if none), n_entries (entries in force that match) and blocked. An entry names a domain with all
    below it, or that and a first path segment (``example.com/ads``).

    A capture whose URL is null, empty or has no host, or whose fetch time is null, matches nothing.
    Very long URLs are matched whole. A capture at the very time of an event is judged after it. Rows
    that repeat are evaluated each; empty tables give no matches or no rows. Columns of ``captures``
    may have any names, other columns of either table are not read.

    List entries meet distinct (host, section) pairs only, which are counted out before any shuffle;
    captures then join the entries of their own pair. The tables joined are written first, so that a
    hot host can be split.
    """
    rows = captures.select(*keep, F.col(fetched).alias("__at"), host_of(F.col(url)).alias("__host"), section_of(F.col(url)).alias("__section"))
    sites = rows.where("__host IS NOT NULL").select("__host", "__section").distinct()
    keys = sites.select("__host", "__section", F.explode(list_keys(F.col("__host"), F.col("__section"))).alias("__key"))
    valid = cut(intervals(events), "intervals")
    met = keys.join(valid, keys["__key"] == valid["entry"])
    entry = F.struct("list", "entry", "since", "until")
    per_site = cut(met.groupBy(F.col("__host").alias("__h"), F.col("__section").alias("__s")).agg(F.collect_list(entry).alias("__entries")), "sites")
    joined = rows.join(per_site, (F.col("__host") == F.col("__h")) & (F.col("__section") == F.col("__s")), "left")
    active = F.filter("__entries", lambda e: (e["since"] <= F.col("__at")) & (e["until"].isNull() | (F.col("__at") < e["until"])))
    judged = joined.withColumn("__active", F.coalesce(active, F.array()))
    return judged.select(
        *keep,
        F.col("__host").alias("host"),
        F.when(F.col("__host").isNotNull(), F.col("__section")).alias("section"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("__active", lambda e: e["list"]))), ",").alias("lists"),
        F.size("__active").cast("bigint").alias("n_entries"),
        (F.size("__active") > 0).alias("blocked"),
    )
