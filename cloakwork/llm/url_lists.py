"""Allowing and blocking captured addresses by lists whose entries come and go.

Dated changes of a list become the intervals in which an entry holds.  A capture meets the entries for its host,
for every domain above it and for every folder of its path, as they stood when it was fetched; the most specific one
decides, and blocking goes before allowing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import let

# Captures and intervals meet within a span of that many days, so that the captures of one host are dealt out by
# time as well.
SPAN_DAYS = 30


def address_keys(url: Column) -> Column:
    """``array<struct<key, depth>>``: the entries that an address can meet, from the top domain to the whole path.

    Keys are hosts and domains as they are, and host and path up to a slash; the depth counts labels and folders.
    """
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)

    def of_host(labels: Column) -> Column:
        n = F.size(labels)
        return F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.struct(F.array_join(F.slice(labels, n - i + 1, i), ".").alias("key"), i.alias("depth")),
        )

    def of_path(parts: Column) -> Column:
        n = F.size(parts)
        deep = F.filter(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: i <= n)
        labels = F.size(F.split(host, r"\."))
        return F.transform(
            deep,
            lambda i: F.struct(
                F.concat(host, F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("key"), (labels + i).alias("depth")
            ),
        )

    keys = F.concat(let(F.split(host, r"\."), of_host), let(F.split(F.regexp_replace(path, "/+$", ""), "/"), of_path))
    return F.when(host != "", keys).otherwise(F.array().cast("array<struct<key:string,depth:int>>"))


def intervals(changes: DataFrame) -> DataFrame:
    """``(list, key, action, since, until)`` from ``changes (list, key, action, at, added)``.

    An entry is one key in one list with one action.  A change adds it (``added``) or takes it away from its time on;
    the state holds until the next change of the entry.  Changes of one time: taking away goes last and counts.
    Repeated changes are one.  Rows with a null in any column are no changes.
    """
    dated = changes.select("list", "key", "action", "at", "added").dropna().distinct()
    one = dated.groupBy("list", "key", "action", "at").agg(F.min("added").alias("added"))
    entry = Window.partitionBy("list", "key", "action").orderBy("at")
    states = one.withColumn("until", F.lead("at").over(entry))
    return states.where("added").select("list", "key", "action", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, changes: DataFrame, url_col: str, time_col: str, span_days: int = SPAN_DAYS) -> DataFrame:
    """Every capture with ``action`` (``block``, ``allow`` or null if no entry holds), ``entry`` and ``list``.

    Of the entries that hold at the time of the capture (from its first moment on, up to but without its last), the
    one with the greatest depth decides; at equal depth ``block`` goes before ``allow``, then the smaller list name
    and key.  A capture without a host or a time meets no entry.  Repeated captures each get their result.
    """
    span = lambda at: F.floor(F.unix_seconds(at.cast("timestamp")) / (86400 * span_days))
    lists = intervals(changes)
    distinct = captures.select(F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("at")).distinct()
    keyed = distinct.select("url", "at", F.explode(address_keys(F.col("url"))).alias("k")).select(
        "url", "at", F.col("k.key").alias("key"), F.col("k.depth").alias("depth"), span(F.col("at")).alias("span")
    )
    ends = distinct.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    if ends.lo is None:
        lo = hi = F.lit(None).cast("timestamp")
    else:
        lo, hi = F.lit(ends.lo), F.lit(ends.hi)
    # An interval is in every span that it shares with the captures.
    first, last = F.greatest("since", lo), F.least(F.coalesce("until", hi), hi)
    spread = lists.where((F.col("since") <= hi) & (F.coalesce("until", hi) >= lo)).select(
        "*", F.explode(F.sequence(span(first), span(last))).alias("span")
    )
    holds = (F.col("c.at") >= F.col("e.since")) & (F.col("e.until").isNull() | (F.col("c.at") < F.col("e.until")))
    met = keyed.alias("c").join(
        spread.alias("e"), (F.col("c.key") == F.col("e.key")) & (F.col("c.span") == F.col("e.span")) & holds
    )
    rank = F.struct(
        (-F.col("c.depth")).alias("depth"),
        F.when(F.col("e.action") == "block", 0).otherwise(1).alias("mild"),
        F.col("e.list").alias("list"),
        F.col("c.key").alias("entry"),
        F.col("e.action").alias("action"),
    )
    decided = met.select("c.url", "c.at", rank.alias("rank")).groupBy("url", "at").agg(F.min("rank").alias("rank"))
    decided = decided.select(F.col("url").alias("__url"), F.col("at").alias("__at"), "rank")
    own = (F.col(url_col) == F.col("__url")) & (F.col(time_col).cast("timestamp") == F.col("__at"))
    found = captures.join(decided, own, "left")
    return found.select(
        *[captures[c] for c in captures.columns if c not in ("action", "entry", "list")],
        F.col("rank.action").alias("action"),
        F.col("rank.entry").alias("entry"),
        F.col("rank.list").alias("list"),
    )


def keep_allowed(captures: DataFrame, changes: DataFrame, url_col: str, time_col: str, **options) -> DataFrame:
    """The captures that no entry blocked when they were fetched."""
    found = evaluate(captures, changes, url_col, time_col, **options)
    return found.where(F.coalesce("action", F.lit("allow")) != "block").select(*captures.columns)
