"""Near-duplicate documents by bottom-k sketches of word shingles, all from one hash function.

Documents with the same shingle set are one class from the start.  The sketch of a class is its k smallest
shingle hashes.  Inverted lists of retained values bring classes together: long documents meet on four
neighbouring values of their sketches, short ones on one value of the part of their set that two similar sets
cannot both miss, or on two values where one is in many sets.  The sketch of the union estimates the similarity of a pair, and the full sets decide.
Where members of a list meet, the parities of their sets tell most unlike pairs apart before they are written.

Nothing is cut off in a large list: every class first meets one class of the list, the hub, and all that are
similar to it become one group; only classes of different groups are then compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .common import SMALL_LIST, components, linked

# Values kept of a set, and neighbouring values that make a key.  At a similarity of exactly 0.8, two long
# documents share no key with a probability of 6e-7.
SKETCH = 64
RUN = 4
# Sets up to SHORT meet on single values, sets from SKETCH on neighbours: similar sets always have one in common.
SHORT = SKETCH * 5 // 4

# A set's parities: one bit for each of 64 times so many places, set if an odd number of its hashes fall there.
PARITIES = 16

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LONGS = pa.list_(pa.int64())


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[3]
    x = (x ^ (x >> np.uint64(29))) * _MIX[0]
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of the ``size``-word shingles of a text, sorted; a text of fewer words is one shingle."""
    # bytes.lower changes A-Z only, and bytes.split cuts at the six ASCII white-space characters.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = mixed * _MIX[1] + _finish(word[i : len(words) - width + 1 + i] + _MIX[2])
    return np.unique(_finish(mixed).view(np.int64))


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63


def parities(hashes: np.ndarray) -> np.ndarray:
    """``PARITIES`` numbers.  Each hash that only one of two sets has changes one bit, so two sets have at least as many
    hashes apart as their parities have bits."""
    bits = np.bincount(hashes & (64 * PARITIES - 1), minlength=64 * PARITIES).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def _sketches(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                hashes = shingle_hashes(text, size)
                rows.append((len(hashes), *_digest(hashes), hashes[:k], parities(hashes)))
            columns = [pa.array([r[i] for r in rows], _LONGS if i >= 3 else pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns], names=["id", "n", "high", "low", "sketch", "parity"])

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, size) for t in batch["text"].to_pylist()]
            high, low = zip(*map(_digest, sets), strict=True) if sets else ((), ())
            columns = [batch["id"], pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sets, _LONGS)]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "high", "low", "shingles"])

    return run


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """``(key, id, n)``: the inverted lists of all classes."""
    long = classes.where(F.col("n") >= SKETCH).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size("sketch") - RUN),
                lambda i: F.xxhash64(*[F.get("sketch", i + j) for j in range(RUN)]),
            )
        ).alias("key"),
        "id",
        "n",
    )
    # Two sets of that similarity share one of the first n - ceil(n * similarity) + 1 values of either.  Their
    # sizes fall into the same or neighbouring steps of that ratio.
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    step = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(percent / 100)) + 1e-9)
    short = classes.where((F.col("n") > 1) & (F.col("n") <= SHORT)).select(
        "id", "n", F.slice("sketch", F.lit(1), first.cast("int")).alias("values"),
        F.slice("sketch", F.lit(1), (first + 1).cast("int")).alias("wider"), F.array(step, step + 1).alias("steps"),
    )
    single = short.select(F.explode("values").alias("value"), "id", "n", "steps").select("value", "id", "n", F.explode("steps").alias("step"))
    single = single.withColumn("key", F.xxhash64("value", "step", F.lit(1)))
    # With one value more of either set, two similar sets share two values.  So where a value is in many sets, those meet
    # on that value and a second one.
    common = single.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SMALL_LIST).select("key")
    plain = single.join(common, "key", "left_anti").select("key", "id", "n")
    wide = single.join(common, "key", "left_semi").join(short.select("id", "wider"), "id")
    wide = wide.select("value", "step", "id", "n", F.explode("wider").alias("second")).where("value <> second")
    pair = F.xxhash64(F.least("value", "second"), F.greatest("value", "second"), "step", F.lit(2))
    return long.unionByName(plain).unionByName(wide.select(pair.alias("key"), "id", "n").distinct())


def _few_apart(l: str, r: str, percent: int) -> Column:
    """Whether two sets can be similar, by their sizes and parities; similar sets always pass.

    Sets of n and m values with a share J of their union in common have (n + m) * (1 - J) / (1 + J) values apart.
    """
    bits = [F.bit_count(F.col(f"{l}.p{i}").bitwiseXOR(F.col(f"{r}.p{i}"))) for i in range(PARITIES)]
    return reduce(lambda x, y: x + y, bits) * (100 + percent) <= (F.col(f"{l}.n") + F.col(f"{r}.n")) * (100 - percent)


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that are similar: estimated on the sketch of the union, decided on the full sets."""
    own = lambda side, table, column: table.select(F.col("id").alias(side), F.col(column).alias(f"{column}_{side}"))
    met = pairs.join(own("a", sketches, "sketch"), "a").join(own("b", sketches, "sketch"), "b")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    both = F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union)
    # Six standard deviations below the threshold.
    share = percent / 100
    slack = 6 * (share * (1 - share) / SKETCH) ** 0.5
    likely = met.where(F.size(both) >= F.size(union) * max(0.0, share - slack)).select("a", "b")
    full = likely.join(own("a", sets, "shingles"), "a").join(own("b", sets, "shingles"), "b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    total = F.size("shingles_a") + F.size("shingles_b") - common
    return full.where(common * 100 >= total * percent).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_shingles``, ``component_id`` and ``kept``.

    Words are what lies between ASCII white space, A-Z in lower case; documents whose shingle sets overlap in at
    least ``percent`` of their union are linked, and a component's id is its smallest document id.  A null or
    wordless text has no shingles and no links.  A row without an id gets a null component and is kept; rows of
    one id belong to one component.  Empty tables give empty results; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = rows.mapInArrow(
        _sketches(shingle_words, SKETCH), "id long, n long, high long, low long, sketch array<long>, parity array<long>"
    )
    sketched = stored(sketched, "sketches")
    some = sketched.where("n > 0 and id is not null")
    named = some.groupBy("high", "low", "n").agg(F.min("id").alias("rep"))
    named = stored(named, "classes")
    # One row per class; rows of one id may hold several texts, so a class is named by its own number.
    number = F.xxhash64("high", "low", "n")
    alike = some.groupBy("high", "low", "n").agg(F.first("sketch").alias("sketch"), F.first("parity").alias("parity"))
    parity = [F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(PARITIES)]
    classes = stored(alike.select(number.alias("id"), "n", "sketch", *parity), "classes")

    used: list[DataFrame] = []

    def tables(involved: DataFrame) -> tuple[DataFrame, DataFrame]:
        sets = _sets_of(rows, named, involved, number, shingle_words)
        sketches = classes.select("id", "sketch").join(involved, "id", "left_semi")
        used.extend([stored(sketches, "sketches"), sets])
        return used[0], sets

    def close(l: str, r: str) -> Column:
        n, m = F.col(f"{l}.n"), F.col(f"{r}.n")
        return (n * 100 >= m * percent) & (m * 100 >= n * percent)

    def marks(own: tuple[DataFrame, DataFrame]) -> DataFrame:
        return classes.select("id", *[f"p{i}" for i in range(PARITIES)])

    def near(l: str, r: str) -> Column:
        return _few_apart(l, r, percent)

    def similar(pairs: DataFrame, own: tuple[DataFrame, DataFrame]) -> DataFrame:
        return _verified(pairs, *own, percent)

    lists = stored(_lists(classes, percent), "lists")
    links = linked(lists, similar, tables, close, marks=marks, near=near, every=True)
    discard(lists, classes, named, *used)

    # Classes become documents again: rows of one class, and rows of one id, are together.
    by_class = components(links).select(F.col("node").alias("class"), F.col("component").alias("group"))
    of_row = some.select("id", number.alias("class")).distinct().join(by_class, "class", "left")
    of_row = of_row.select("id", F.coalesce("group", "class").alias("group"))
    lowest = of_row.groupBy("group").agg(F.min("id").alias("lowest"))
    chained = of_row.join(lowest, "group").select(F.col("id").alias("a"), F.col("lowest").alias("b")).where("a <> b")
    found = components(chained).select(F.col("node").alias("id"), F.col("component").alias("component_id"))
    named_rows = sketched.select("id", F.col("n").alias("n_shingles")).join(found, "id", "left")
    component = F.coalesce("component_id", "id")
    return named_rows.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        (F.col("id").isNull() | (component == F.col("id"))).alias("kept"),
    )


def _sets_of(rows: DataFrame, named: DataFrame, involved: DataFrame, number: Column, size: int) -> DataFrame:
    """The full sets of the classes that share a list with another, from the text of one document each."""
    wanted = named.select(number.alias("class"), "rep", "high", "low").join(
        involved.select(F.col("id").alias("class")), "class", "left_semi"
    )
    texts = rows.join(wanted.select("rep"), F.col("id") == F.col("rep"), "left_semi")
    full = texts.mapInArrow(_full_sets(size), "rep long, high long, low long, shingles array<long>")
    # Rows of one id may differ in text, so the digest belongs to the key.
    found = full.join(wanted, ["rep", "high", "low"]).select(F.col("class").alias("id"), "shingles")
    return stored(found.dropDuplicates(["id"]), "sets")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows whose document is the first of its component; rows without an id stay."""
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
