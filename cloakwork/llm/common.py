"""What several operators share: row keys, connected components, words."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# What stands in a key for a missing number.
NO_ID = -(2**63)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two longs, never null, that tell rows apart by id and text; equal rows have equal keys."""
    number = F.col(id_col).cast("long")
    return [
        F.coalesce(number, F.lit(NO_ID)).alias("__k1"),
        F.xxhash64(F.col(text_col), number.isNull(), F.col(text_col).isNull()).alias("__k2"),
    ]


KEY = ["__k1", "__k2"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links ``(a, b)`` of numbers: ``(node, component)``, the component being its
    smallest node; nodes without links are left out.

    Large-star and small-star rounds: every node hands its larger neighbours, then its smaller ones, to the
    smallest it knows, until nothing changes.  The number of rounds grows with the logarithm of the size of a
    component; a node with very many links is a hot key of a sort-merge join only, which Spark can split, and
    the minimum over its links is taken before the shuffle.  Each round is a table in shared scratch space.
    """
    links = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    links = stored(links, "links")
    before = _mark(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        large = (
            both.join(low.select(F.col("u").alias("u2"), "low"), F.col("u") == F.col("u2"))
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
            .distinct()
        )
        large, old = stored(large, "links"), links
        least = large.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("u2"), "low")
        small = (
            large.join(least, F.col("u") == F.col("u2"))
            .select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
            .distinct()
        )
        links = stored(small, "links")
        discard(large, old)
        after = _mark(links)
        if after == before:
            break
        before = after
    root = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return root.unionByName(root.select(F.col("component").alias("node"), "component").distinct())


def _mark(links: DataFrame) -> tuple:
    """Enough to see whether a set of links has changed."""
    h = F.xxhash64("u", "v")
    halves = [F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))]
    return tuple(links.agg(F.count(F.lit(1)), *halves).first())


# Lists of up to so many members are compared within themselves; larger ones first meet one member after another.
SMALL_LIST = 64
MOST_ROUNDS, LEAST_YIELD = 12, 0.1


def linked(
    lists: DataFrame,
    verify: Callable[[DataFrame, DataFrame], DataFrame],
    prepare: Callable[[DataFrame], DataFrame],
    may: Callable[[str, str], Column],
    of_list: Sequence[Column] = (),
    worth: Column | None = None,
    marks: Callable[[DataFrame], DataFrame] | None = None,
    near: Callable[[str, str], Column] | None = None,
    every: bool = False,
) -> DataFrame:
    """Links ``(a, b)`` that join up all similar members of any list of ``(key, id, ...)``.

    First every member meets the smallest and the largest of its lists, of each the one that it shares most
    lists with, and similar ones become groups.  What is left of a large list, members of several groups, then meets one
    member after another, drawn by hash, for as long as a tenth of them prove similar.  At last members of one list in
    different groups meet each other.  So a large list of copies costs some pairs per member, and no two
    similar members stay in different components.

    ``prepare(ids)`` makes the table that ``verify(pairs, table)`` decides with; ``may(l, r)`` is a cheap test of
    two members by their further columns.  ``worth`` tells by further aggregates ``of_list`` which lists may hold
    similar members at all.  ``marks(table)`` is a table ``(id, ...)`` of what ``near(l, r)`` needs, a test that all
    similar members pass: the last step asks it where members meet, so that other pairs are never written.
    With ``every``, for tests that few unlike members pass, a large list asks it of all members and the one drawn, and
    verifies all that pass; members are drawn until what passes foretells no more pairs of the last step than there
    are members in lists.
    """
    hubs = lists.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("other"), *of_list)
    hubs = hubs.where("hub <> other") if worth is None else hubs.where("hub <> other").where(worth)
    hubs = stored(hubs.select("key", "hub", "other"), "hubs")
    members = stored(lists.join(hubs, "key"), "members")
    discard(hubs)
    table = prepare(members.select("id").distinct())

    def met(rows: DataFrame, hub: str) -> DataFrame:
        counted = rows.where(F.col("id") != F.col(hub)).groupBy("id", hub).agg(F.count(F.lit(1)).alias("shared"))
        top = counted.groupBy("id").agg(F.max(F.struct("shared", hub)).alias("top"))
        return top.select(F.least("id", f"top.{hub}").alias("a"), F.greatest("id", f"top.{hub}").alias("b"))

    tried = stored(met(members, "hub").unionByName(met(members, "other")).distinct(), "pairs")
    links = stored(verify(tried, table), "links")
    before = members.drop("hub", "other")
    for turn in range(MOST_ROUNDS + 1):
        group = components(links).select(F.col("node").alias("id"), F.col("component").alias("group"))
        grouped = before.drop("group").join(group, "id", "left").withColumn("group", F.coalesce("group", "id"))
        grouped = stored(grouped, "members")
        sizes = grouped.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("size"))
        mixed = sizes.where("lo <> hi")
        apart = stored(grouped.join(mixed.select("key", "size"), "key"), "members")
        discard(grouped, before if turn else members)
        before = apart.drop("size")
        large = apart.where(F.col("size") > SMALL_LIST)
        if turn == MOST_ROUNDS or large.isEmpty():
            break
        if every:
            asked = stored(_near_drawn(large, marks(table), turn, may, near), "asked")
            ahead = asked.agg(F.sum(F.col("size") / 2)).first()[0] or 0
            if ahead <= apart.count():
                discard(asked)
                break
            pairs = asked.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        else:
            drawn = large.groupBy("key").agg(F.min_by(F.struct("id", "group"), F.xxhash64("id", F.lit(turn))).alias("hub"))
            asked = large.join(drawn, "key").where(F.col("group") != F.col("hub.group")).select("id", F.col("hub.id").alias("hub"))
            pairs = met(asked, "hub")
        new = stored(pairs.join(tried, ["a", "b"], "left_anti").distinct(), "pairs")
        if every:
            discard(asked)
        found = stored(verify(new, table), "links")
        # Where members are like few others, drawing more of them finds little: the last step compares them all.
        yields = every or found.count() >= new.count() * LEAST_YIELD
        links, tried = stored(links.unionByName(found), "links"), stored(tried.unionByName(new), "pairs")
        discard(new, found)
        if not yields:
            break
        before = apart.drop("size")
        before._scratch_path = apart._scratch_path
    condition = (F.col("l.key") == F.col("r.key")) & (F.col("l.group") < F.col("r.group")) & may("l", "r")
    if marks is not None:
        bare, apart = apart, stored(apart.join(marks(table), "id"), "members")
        discard(bare)
        condition = condition & near("l", "r")
    rest = (
        apart.alias("l")
        .join(apart.alias("r"), condition)
        .select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    done = stored(links.unionByName(verify(rest, table)), "links")
    discard(apart, tried, links)
    return done


def _near_drawn(
    large: DataFrame, marks: DataFrame, turn: int, may: Callable[[str, str], Column], near: Callable[[str, str], Column]
) -> DataFrame:
    """``(id, hub, size)``: of each list one member drawn by hash, and those of other groups that may be like it."""
    member = F.struct(*[c for c in large.columns if c != "key"])
    drawn = large.groupBy("key").agg(F.min_by(member, F.xxhash64("id", F.lit(turn))).alias("hub"))
    others = large.join(drawn.select("key", F.col("hub.group").alias("own")), "key").where("group <> own").drop("own")
    l, r = others.join(marks, "id").alias("l"), drawn.select("key", "hub.*").join(marks, "id").alias("r")
    condition = (F.col("l.key") == F.col("r.key")) & may("l", "r") & near("l", "r")
    return l.join(r, condition).select("l.id", F.col("r.id").alias("hub"), "l.size")
