"""URL filters by dated lists: a temporal join of captures and list entries.

Dated additions and removals become validity intervals. A capture is held against the entries that were active when it was
fetched: its host, the host's parent domains and its path prefixes are the keys of an as-of join on (key, month), in which
an interval stands once for each month it touches, so that the join is an equality with a bounded rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from widesift.session import cut_lineage

FOREVER = "9999-12-31"
KEYS = ("host", "domain", "prefix")


def validity(entries: DataFrame) -> DataFrame:
    """(list, kind, value, since, until) from events (list, kind, value, action, dated); an entry is active on since <= day < until.

    action is `add` or `remove`. Of several events of an entry on one day an addition counts. A removal of what is not listed
    and a second addition change nothing. Values are lower-cased. Events with a null in any of the columns are ignored.
    """
    columns = ["list", "kind", "value", "action", "dated"]
    known = entries.select(*columns).dropna().withColumn("value", F.lower("value")).where(F.col("action").isin("add", "remove"))
    # one event for each day and entry, so an entry has no more of them than there are days
    days = known.groupBy("list", "kind", "value", F.col("dated").cast("date").alias("since")).agg(F.min("action").alias("action"))
    order = Window.partitionBy("list", "kind", "value").orderBy("since")
    changed = days.withColumn("before", F.lag("action", 1, "remove").over(order)).where(F.col("action") != F.col("before"))
    ended = changed.withColumn("until", F.coalesce(F.lead("since").over(order), F.lit(FOREVER).cast("date")))
    return ended.where(F.col("action") == "add").select("list", "kind", "value", "since", "until")


def host_of(url: Column) -> Column:
    """The lower-cased host of an absolute URL, without user, port and closing dot; null if there is none."""
    host = F.rtrim(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)", 1), F.lit("."))
    return F.when(host != "", host)


def keys_of(url: Column) -> Column:
    """array<struct<kind, value>> an entry may match: the host, the host and its parents as domains, host and path up to each slash."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    path = F.split(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1), "/")
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: key("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(F.filter(F.sequence(F.lit(1), F.size(path)), lambda i: F.get(path, i - 1) != ""),
                           lambda i: key("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(path, F.lit(1), i), "/"))))
    return F.array_distinct(F.concat(F.array(key("host", host)), domains, prefixes))


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def active(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """`captures` with the column lists: the sorted names of the lists that an entry of which was active at the time of the fetch.

    Every capture keeps its row, repeated ones too. Captures without a URL, host or time are on no list. Captures of one URL on
    one day are judged once. A column named lists or day is replaced.
    """
    rows = captures.drop("lists", "day").withColumn("day", F.col(time_col).cast("date"))
    judged = rows.select(F.col(url_col).alias("url"), "day").where(host_of(F.col("url")).isNotNull() & F.col("day").isNotNull()).distinct()
    keys = judged.withColumn("k", F.explode(keys_of(F.col("url")))).select("url", "day", "k.kind", "k.value", _month(F.col("day")).alias("month"))
    span = judged.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    first, last = span.first()
    if first is None:
        return rows.drop("day").withColumn("lists", F.array().cast("array<string>"))
    # within the months that captures have, an interval has a row for each of its months
    bound = lambda day: F.greatest(F.least(day, F.lit(last)), F.lit(first))
    intervals = validity(entries).where((F.col("since") <= F.lit(last)) & (F.col("until") > F.lit(first)))
    monthly = cut_lineage(intervals.withColumn("month", F.explode(F.sequence(_month(bound(F.col("since"))), _month(bound(F.col("until")))))))
    hits = keys.join(monthly, ["kind", "value", "month"]).where((F.col("since") <= F.col("day")) & (F.col("day") < F.col("until")))
    found = cut_lineage(hits.groupBy("url", "day").agg(F.array_sort(F.collect_set("list")).alias("lists")))
    out = rows.withColumn("url_", F.col(url_col)).join(found.withColumnRenamed("url", "url_"), ["url_", "day"], "left").drop("url_", "day")
    return out.withColumn("lists", F.coalesce("lists", F.array().cast("array<string>")))
