"""Benchmark passages in training text: windows of test items, found, verified and taken out.

Every window of an item is known by its longest word.  The distinct windows travel to all executors, in blocks
of checked size; the words of the documents stream past them, and where a word is the longest of some window,
the words around it are compared with the whole window.  Text is not shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..session import stored
from .common import KEY, ascii_lower, row_key

# What a word cannot hold, after A-Z are in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The same before that.
_GAPS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"

# Bytes of windows that are broadcast at a time; more are scanned for in further passes.
BLOCK_BYTES = 32_000_000

# Rows of windows cost at least that much besides their words.
_ROW_BYTES = 200


def words_of(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def windows_of(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(item, window)``: the distinct windows of ``size`` words of every item, or all its words if fewer."""
    cut = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)

    def windows(words: Column) -> Column:
        n = F.size(words)
        starts = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))
        # Word by word: a slice would go through the whole array for each window.
        places = F.sequence(F.lit(0), F.least(n, F.lit(size)) - 1)
        return F.transform(starts, lambda at: F.transform(places, lambda j: F.get(words, at + j)))

    return cut.select("item", F.explode(F.array_distinct(let(F.col("words"), windows))).alias("window")).distinct()


def _anchored(windows: DataFrame) -> DataFrame:
    """Distinct windows with an id, their longest word and where it stands."""
    longest = F.array_max(F.transform("window", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    one = windows.select("window").distinct()
    return one.select(
        F.xxhash64("window").alias("w1"),
        F.col("window"),
        longest.alias("anchor"),
        (F.array_position("window", longest) - 1).cast("int").alias("offset"),
        (F.lit(_ROW_BYTES) + F.aggregate("window", F.lit(0), lambda n, w: n + F.octet_length(w) + 24)).alias("bytes"),
    )


def _scan(docs: DataFrame, block: DataFrame, id_col: str, text_col: str, with_rows: bool) -> DataFrame:
    """``(k1, k2, n_words, at, n, w1)`` per occurrence; with rows, also one row per document whose ``w1`` is null.

    An empty word behind the last one meets an empty window, so that every document leaves a row in this one pass.
    """
    own = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("__id"), words_of(F.col(text_col)).alias("__words"))
    padded = own.withColumn("__words", F.concat("__words", F.array(F.lit(""))))
    stream = padded.select(*KEY, "__id", "__words", F.posexplode_outer("__words").alias("__pos", "__word"))
    if with_rows:
        end = block.sparkSession.range(1).select(
            F.lit(None).cast("long").alias("w1"), F.array(F.lit("")).alias("window"), F.lit("").alias("anchor"), F.lit(0).alias("offset")
        )
        block = block.select("w1", "window", "anchor", "offset").unionByName(end)
    start = F.col("__pos") - F.col("offset")
    same = (start >= 0) & (F.slice("__words", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window"))
    met = stream.join(F.broadcast(block), (F.col("__word") == F.col("anchor")) & same)
    return met.select(*KEY, "__id", (F.size("__words") - 1).cast("long").alias("n_words"), start.alias("at"), F.size("window").alias("n"), "w1")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
) -> DataFrame:
    """Per row of ``docs``: its keys, ``n_words``, ``hits`` (positions of the words inside any window, sorted) and
    ``items`` (the ids of the items with windows there).

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case.  An item of fewer words than
    a window is one window; one without words, or null, has none.  A null document has no words.  Equal rows are
    looked at once and returned as often as they come.  Without items, nothing is hit.
    """
    windows = stored(windows_of(items, item_col, item_text_col, window), "windows")
    anchored = stored(_anchored(windows), "anchors")
    total = anchored.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    blocks = total // BLOCK_BYTES + 1
    part = lambda i: anchored.where(F.pmod("w1", F.lit(blocks)) == i).drop("bytes")
    found = reduce(
        DataFrame.unionByName,
        [_scan(docs, part(i), id_col, text_col, with_rows=i == 0) for i in range(blocks)],
    )
    found = stored(found, "windows-found")
    spans = found.where("w1 is not null")
    rows = found.where("w1 is null").groupBy(*KEY, "__id", "n_words").agg(F.count(F.lit(1)).alias("copies"))
    covered = F.array_sort(
        F.array_distinct(
            F.flatten(F.transform(F.collect_set(F.struct("at", "n")), lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))
        )
    )
    hits = spans.groupBy(*KEY).agg(covered.alias("hits"))
    whose = windows.join(anchored.select("w1", "window"), "window").select("w1", "item")
    of_doc = spans.select(*KEY, "w1").distinct().join(whose, "w1").groupBy(*KEY).agg(F.collect_set("item").alias("items"))
    return (
        rows.join(hits, KEY, "left")
        .join(of_doc, KEY, "left")
        .select(
            *KEY,
            "__id",
            "n_words",
            F.coalesce("hits", F.array().cast("array<int>")).alias("hits"),
            F.coalesce("items", F.array().cast(of_doc.schema["items"].dataType)).alias("items"),
            F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("__copy"),
        )
        .drop("__copy")
    )


def _without(text: Column, hits: Column) -> Column:
    """A text without the words at some positions, each with the gap before it."""
    pieces = F.regexp_extract_all(text, F.lit(f"([{_GAPS}]*[^{_GAPS}]+|[{_GAPS}]+$)"), F.lit(1))

    def rest(found: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(found) - 1), hits)
        return F.array_join(F.transform(kept, lambda i: F.get(found, i)), "")

    return F.when(F.size(hits) == 0, text).otherwise(let(pieces, rest))


def decontaminate(
    docs: DataFrame, items: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Rows without benchmark passages: ``remove="documents"`` drops the rows that hold one, ``"spans"`` cuts the
    words of the passages out of the text.  Rows without hits come back as they are, null texts included."""
    found = contamination(docs, items, id_col, text_col, **options).where(F.size("hits") > 0)
    found = found.select(F.col("__k1").alias("__h1"), F.col("__k2").alias("__h2"), "hits").dropDuplicates(["__h1", "__h2"])
    k1, k2 = row_key(id_col, text_col)
    match = (k1 == F.col("__h1")) & (k2 == F.col("__h2"))
    if remove == "documents":
        return docs.join(found, match, "left_anti")
    met = docs.join(found.withColumnRenamed("hits", "__hits"), match, "left")
    cut = _without(F.col(text_col), F.col("__hits"))
    new = F.when(F.col("__hits").isNull(), F.col(text_col)).otherwise(cut)
    return met.select(*[new.alias(c) if c == text_col else met[c] for c in docs.columns])
