"""Document fingerprints: a Merkle tree over the sections, paragraphs and clauses of a text.

A paragraph is a line; a section is a run of paragraphs that ends where a paragraph's hash says so, so that an
edit moves no boundary but its own; a paragraph's leaves are its clauses, cut after punctuation, long ones further where their characters say so.  Each node's hash
is made from those below it.  Equal roots mean equal texts; where roots differ, the branches that differ lead to
the edit, without the texts.

The fingerprint is a string: the root in 32 hexadecimal digits, then the paragraphs, each as a mark (``/`` where a
section begins, else ``:``), its node in 32 digits and its leaves in eight digits each.  A section's node is the hash of
the nodes of its paragraphs, and the root that of the sections' nodes, so both follow from what is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import let
from .common import NO_ID

# One paragraph in so many ends a section.
SECTION = 8
_LEAF, _NODE = 8, 32
# A clause of more characters is cut where the hash of the four characters before says so, one place in so many, and
# after so many characters at the latest.
_LONG, _WINDOW, _PLACES, _LATEST = 128, 4, 32, 256
# ASCII marks end a clause before white space, those of other scripts anywhere.
_ENDS = r"(?<=[.,;:!?|])(?=\s)|(?<=[。、，；：！？｡､।॥؟،؛۔])"


def _pieces(clause: Column) -> Column:
    """A clause, or the pieces of a long one; they hold every character of it."""

    def cut(chars: Column) -> Column:
        seen = lambda i: F.xxhash64(*[F.get(chars, i - k) for k in range(1, _WINDOW + 1)])
        at = F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: (i == 0) | (F.pmod(seen(i), F.lit(_PLACES)) == 0))
        until = lambda starts, j: F.coalesce(F.get(starts, j + 1), F.size(chars))
        every = lambda a: F.flatten(F.transform(a, lambda s, j: F.sequence(s, until(a, j) - 1, F.lit(_LATEST))))
        slices = lambda b: F.transform(b, lambda s, j: F.array_join(F.slice(chars, s + 1, until(b, j) - s), ""))
        return let(let(at, every), slices)

    return F.when(F.length(clause) <= _LONG, F.array(clause)).otherwise(let(F.split(clause, ""), cut))


def _digest(x: Column) -> Column:
    return F.md5(x.cast("binary"))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty.  Equal texts have equal fingerprints, and different texts
    different roots but for collisions of a 128-bit hash: every node hashes the whole hashes below it."""
    def paragraph(line: Column) -> Column:
        digests = F.transform(F.flatten(F.transform(F.split(line, _ENDS), _pieces)), _digest)
        return let(digests, node)

    def node(digests: Column) -> Column:
        short = F.transform(digests, lambda d: F.substring(d, 1, _LEAF))
        return F.struct(_digest(F.array_join(digests, "")).alias("hash"), F.array_join(short, "").alias("leaves"))

    def tree(nodes: Column) -> Column:
        # A mark before each paragraph: a new section where its hash begins with one of two digits.
        mark = lambda n: F.when(F.substring(n["hash"], 1, 1).isin(*"0123456789abcdef"[: 16 // SECTION]), "/").otherwise(":")
        whole = F.array_join(F.transform(nodes, lambda n: F.concat(mark(n), n["hash"])), "")
        top = _digest(F.array_join(F.transform(F.split(whole, "/"), _digest), ""))
        return F.concat(top, F.array_join(F.transform(nodes, lambda n: F.concat(mark(n), n["hash"], n["leaves"])), ""))

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), paragraph), tree)


def root(mark: Column) -> Column:
    return F.substring(mark, 1, _NODE)


def _below(mark: Column) -> Column:
    return F.substring(mark, _NODE + 1, 2**31 - 1)


def _of_sections(mark: Column) -> Column:
    """For each section the marks and nodes of its paragraphs."""
    return F.split(F.regexp_replace(_below(mark), f"([:/][0-9a-f]{{{_NODE}}})[0-9a-f]*", "$1"), "/")


def sections(mark: Column) -> Column:
    """The nodes of the sections, in order; the root is the hash of these.  The first is empty where the first paragraph
    begins a section."""
    return F.transform(_of_sections(mark), _digest)


def paragraphs(mark: Column) -> Column:
    """The nodes of the paragraphs, in order."""
    return F.regexp_extract_all(_below(mark), F.lit(f"[:/]([0-9a-f]{{{_NODE}}})"), F.lit(1))


def leaves(mark: Column) -> Column:
    """The leaves in order, eight digits each."""
    only = F.regexp_replace(_below(mark), f"[:/][0-9a-f]{{{_NODE}}}", "")
    return F.regexp_extract_all(only, F.lit(f"(.{{{_LEAF}}})"), F.lit(1))


def _counted(nodes: Column) -> Column:
    """``(label, at)`` for each ``(node, at)``: the label has the node and how many equal ones are before it."""

    def numbered(ordered: Column) -> Column:
        node = lambda i: F.get(ordered, i)["node"]
        first = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (node(i) != node(i - 1)))

        def runs(starts: Column) -> Column:
            until = lambda j: F.coalesce(F.get(starts, j + 1), F.size(ordered))
            label = lambda s, i: F.struct(F.concat_ws("#", node(i), (i - s).cast("string")).alias("label"), F.get(ordered, i)["at"].alias("at"))
            return F.flatten(F.transform(starts, lambda s, j: F.transform(F.sequence(s, until(j) - 1), lambda i: label(s, i))))

        return let(first, runs)

    none = F.array().cast("array<struct<label:string,at:int>>")
    return let(F.sort_array(nodes), lambda some: F.when(F.size(some) == 0, none).otherwise(numbered(some)))


def _placed(nodes: Column) -> Column:
    return F.transform(nodes, lambda n, i: F.struct(n.alias("node"), i.alias("at")))


def likeness(mark: Column, other: Column) -> Column:
    """From 0 to 1: twice the leaves in common, as often as both have them, by the leaves of both.  It is 1 for equal
    roots only: where the same leaves stand in another order, it lacks the share of one leaf."""

    def share(a: Column, b: Column) -> Column:
        total = F.size(a) + F.size(b)
        return F.least(F.size(F.array_intersect(a, b)) * 2.0, total - 1.0) / total

    labels = lambda m: F.transform(_counted(_placed(leaves(m))), lambda x: x["label"])
    apart = let(labels(mark), lambda a: let(labels(other), lambda b: share(a, b)))
    return F.when(root(mark) == root(other), F.lit(1.0)).otherwise(apart)


def _unmatched(own: Column, theirs: Column) -> Column:
    """The places of the own ``(node, at)`` that have no equal among theirs, or not in the same order."""
    side = lambda nodes, n: F.transform(_counted(nodes), lambda x: F.struct(x["label"].alias("label"), F.lit(n).alias("side"), x["at"].alias("at")))

    def compared(both: Column) -> Column:
        after = lambda i: F.get(both, i + 1)
        # Labels are unlike each other on either side, so equal ones are neighbours, the own first.
        mine = F.filter(F.transform(both, lambda x, i: F.struct(x["at"].alias("at"), x["side"].alias("side"), F.when(after(i)["label"] == x["label"], after(i)["at"]).alias("to"))), lambda x: x["side"] == 0)

        def found(rows: Column) -> Column:
            alone = F.transform(F.filter(rows, lambda x: x["to"].isNull()), lambda x: x["at"])
            met = F.sort_array(F.filter(rows, lambda x: x["to"].isNotNull()))
            order = F.sort_array(F.transform(F.filter(rows, lambda x: x["to"].isNotNull()), lambda x: x["to"]))
            moved = let(order, lambda o: F.filter(F.transform(met, lambda x, i: F.when(x["to"] != F.get(o, i), x["at"])), lambda x: x.isNotNull()))
            return F.sort_array(F.concat(alone, moved))

        return let(mine, found)

    return let(F.sort_array(F.concat(side(own, 0), side(theirs, 1))), compared)


def differing(mark: Column, other: Column) -> Column:
    """Where two texts differ: the positions of the first one's paragraphs (from 0) that the other has not, has fewer
    times, or has in another order.  Equal roots have none; else the sections are compared, and only the paragraphs
    of those that differ."""

    # Bound side by side: every level of nested lambdas costs the analyzer a round.
    return let(F.struct(mark.alias("a"), other.alias("b")), lambda both: _differing(both["a"], both["b"]))


def _differing(mark: Column, other: Column) -> Column:
    def inside(m: Column, chosen: Column) -> Column:
        """``(node, at)`` of the paragraphs of the chosen sections."""
        listed = F.transform(_of_sections(m), lambda s: F.regexp_extract_all(s, F.lit(f"([0-9a-f]{{{_NODE}}})"), F.lit(1)))
        numbered = F.flatten(F.transform(listed, lambda nodes, i: F.transform(nodes, lambda n: F.struct(n.alias("node"), i.alias("section")))))
        placed = F.transform(numbered, lambda n, at: F.struct(n["node"].alias("node"), at.alias("at"), n["section"].alias("section")))
        some = F.filter(placed, lambda n: F.array_contains(chosen, n["section"]))
        return F.transform(some, lambda n: F.struct(n["node"].alias("node"), n["at"].alias("at")))

    def changed(s: Column) -> Column:
        sides = F.struct(_unmatched(s["a"], s["b"]).alias("mine"), _unmatched(s["b"], s["a"]).alias("theirs"))
        return let(sides, lambda u: _unmatched(inside(mark, u["mine"]), inside(other, u["theirs"])))

    found = let(F.struct(_placed(sections(mark)).alias("a"), _placed(sections(other)).alias("b")), changed)
    return F.when(root(mark) == root(other), F.array().cast("array<int>")).otherwise(found)


def with_next(docs: DataFrame, id_col: str, columns: list[str], parts: int, tie: list[str] | None = None) -> DataFrame:
    """Rows with ``next_<column>``: the values of the next row by descending id, after the last those of the first.

    The ids are cut into ``parts`` ranges by their quantiles, and each row goes to its range once; the largest id of
    a range is also sent to the one before, where it follows the last.  Rows without an id come last; rows of one id
    go by the hash of ``tie`` (the columns, if not given), and equal rows are each other's next.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(id_col, *columns, key.alias("__id"), F.xxhash64(*(tie or columns)).alias("__tie"))
    places = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("__id", places, 10 * parts)).first()[0] if places else []
    cuts = sorted(set(cuts or []))
    # Range 0 has the smallest ids: a row belongs to as many ranges up as cuts lie below its id.
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("__part", F.size(F.filter(bounds, lambda c: c < F.col("__id"))))
    # The first row of each range in the order, to follow the last row of the range above.
    heads = rows.groupBy("__part").agg(F.max(F.struct("__id", "__tie")).alias("head")).orderBy(F.desc("__part")).collect()
    # One row of equal ones is enough.
    before = {h["__part"]: heads[i - 1]["__part"] for i, h in enumerate(heads)}
    head = F.create_map(*[F.lit(x) for h in heads for x in (h["__part"], h["head"]["__id"])]) if heads else None
    tie = F.create_map(*[F.lit(x) for h in heads for x in (h["__part"], h["head"]["__tie"])]) if heads else None
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if heads else None
    first = (F.col("__id") == head[F.col("__part")]) & (F.col("__tie") == tie[F.col("__part")]) if heads else F.lit(False)
    guest = F.when(first, to[F.col("__part")]) if heads else F.lit(None).cast("int")
    own = F.struct(F.col("__part").alias("at"), F.lit(0).alias("guest"))
    sent = F.when(guest.isNull(), F.array(own)).otherwise(F.array(own, F.struct(guest.alias("at"), F.lit(1).alias("guest"))))
    dealt = rows.withColumn("__to", F.explode_outer(sent)).select("*", "__to.at", "__to.guest").drop("__to", "__part")
    order = Window.partitionBy("at").orderBy("guest", F.desc("__id"), F.desc("__tie"))
    found = dealt.select(
        id_col, *columns, "guest", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    )
    return found.where("guest = 0").drop("guest")


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the characters replaced by the first as many (or all) of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with the fingerprint of its whole text and its number of characters (code points).

    Null and empty texts are one empty paragraph; equal rows have equal results; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_col, F.length(text).cast("long").alias("n_chars"), fingerprint(text).alias("fingerprint"))
