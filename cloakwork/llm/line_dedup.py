"""Lines that repeat, exactly or nearly, across and within documents: one of each group stays.

A line is compared by its words, in lower case and without punctuation.  Its SimHash has five blocks.  Each word adds
its hash bits to the block that its hash names, and a block has the bits that more than half of its words have; so an
edited word changes two blocks at most.  Lines that agree in two blocks meet: by the pigeonhole principle these are all
lines that differ in at most three blocks, which one replaced word never exceeds and two seldom.  The distance of whole
SimHashes is looked at next, then the edit distance of the words decides.  One occurrence per connected group is kept:
the first by document id and position.  Exact copies of every line with text go, however short it is.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..session import discard, stored
from .common import KEY, components, linked, row_key

# A SimHash has so many blocks, of 18 bits each, and linked lines differ in at most so many of the 90 bits.
BLOCKS = 5
MAX_DISTANCE = 24

# Lines of fewer words than asked for are compared nearly from so many characters on.
MIN_CHARS = 20

# In lines of up to so many words, short words count as well; words longer than that on average (scripts without
# spaces) are cut at one character in four.
_FEW_WORDS, _LONG_WORDS, _CUT = 12, 12, 4

# The hash bits of words are added up in fields of seven bits, nine to a number, two numbers to a block.  At most 63
# words at a time, so that the top bit of each field stays free for comparing.
_FIELD, _FIELDS, _SUMS = 7, 9, 2
_AT_ONCE = 2 ** (_FIELD - 1) - 1
_ONES = sum(1 << (_FIELD * i) for i in range(_FIELDS))
_TOPS = _ONES << (_FIELD - 1)
_BITS = _ONES | _ONES << 1
# Three blocks lie in the first number of a SimHash, two in the second; the numbers of their words have 12 bits each.
_PLACES = [("h1", 0), ("h1", 2), ("h1", 4), ("h2", 0), ("h2", 2)]
_SIZE = 12


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(k1, k2, pos, line)``, and ``row``, which tells repeated rows apart."""
    rows = docs.select(*row_key(id_col, text_col), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.select(*KEY, "row", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))


def _features(words: Column) -> Column:
    """The distinct hashes of what a line's SimHash is made of: its longer words, or all of few, or pieces of runs."""
    longer = F.filter(words, lambda w: F.octet_length(w) > 3)
    chosen = F.when(F.size(words) <= _FEW_WORDS, words).otherwise(let(longer, lambda some: F.when(F.size(some) > 0, some).otherwise(words)))

    def pieces(chars: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(chars) - 1), lambda i: (i == 0) | (F.pmod(F.xxhash64(F.get(chars, i - 1)), F.lit(_CUT)) == 0)
        )
        until = lambda at, j: F.coalesce(F.get(at, j + 1), F.size(chars))
        return let(starts, lambda at: F.transform(at, lambda i, j: F.array_join(F.slice(chars, i + 1, until(at, j) - i), "")))

    text = F.array_join(words, "")
    runs = F.length(text) > _LONG_WORDS * F.size(words)
    some = F.when(runs, let(F.split(text, ""), pieces)).otherwise(chosen)
    return F.array_distinct(F.transform(some, lambda w: F.xxhash64(w)))


def _block(hashes: Column) -> Column:
    """The bits that more than half of the hashes have, at every seventh place and the one above it."""

    def added(k: int) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate(hashes, zero, lambda s, h: s + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_ONES)))

    # All fields of a number are compared at once.
    least = (F.floor(F.size(hashes) / 2) + 1).cast("long")
    over = lambda k: F.shiftrightunsigned((added(k) + F.lit(_TOPS) - least * F.lit(_ONES)).bitwiseAND(F.lit(_TOPS)), _FIELD - 1 - k)
    # More words than a field can count are counted bit by bit.
    places = F.array(*[F.lit(_FIELD * i + k) for i in range(_FIELDS) for k in range(_SUMS)])
    bit = lambda h, p: F.call_function("shiftrightunsigned", h, p).bitwiseAND(F.lit(1).cast("long"))
    count = lambda p: F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + bit(h, p))
    one = lambda p: F.when(count(p) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), p))
    slow = F.aggregate(places, F.lit(0).cast("long"), lambda s, p: s.bitwiseOR(F.coalesce(one(p), F.lit(0).cast("long"))))
    return F.when(F.size(hashes) <= _AT_ONCE, reduce(lambda x, y: x.bitwiseOR(y), [over(k) for k in range(_SUMS)])).otherwise(slow)


def simhash(words: Column) -> Column:
    """``struct<h1, h2, sizes>``: the SimHash of a line's words in two numbers, and how many words each block has."""

    def made(hashes: Column) -> Column:
        def block(b: int) -> Column:
            own = F.filter(hashes, lambda h: F.pmod(h, F.lit(BLOCKS)) == b)
            return let(own, lambda x: F.struct(_block(x).alias("bits"), F.size(x).cast("long").alias("n")))

        blocks = F.array(*[block(b) for b in range(BLOCKS)])

        def packed(found: Column) -> Column:
            either = lambda columns: reduce(lambda x, y: x.bitwiseOR(y), columns)
            number = lambda name: either([F.shiftleft(found[b]["bits"], s) for b, (h, s) in enumerate(_PLACES) if h == name])
            most = F.lit(2**_SIZE - 1).cast("long")
            sizes = either([F.shiftleft(F.least(found[b]["n"], most), _SIZE * b) for b in range(BLOCKS)])
            return F.struct(number("h1").alias("h1"), number("h2").alias("h2"), sizes.alias("sizes"))

        return let(blocks, packed)

    return let(_features(words), made)


def _block_keys(h1: Column, h2: Column, sizes: Column) -> Column:
    """A key for each pair of blocks, if it has two words and a quarter of all words."""
    number = {"h1": h1, "h2": h2}
    block = [F.shiftrightunsigned(number[h], s).bitwiseAND(F.lit(_BITS)) for h, s in _PLACES]
    size = [F.shiftrightunsigned(sizes, _SIZE * b).bitwiseAND(F.lit(2**_SIZE - 1)) for b in range(BLOCKS)]
    total = reduce(lambda x, y: x + y, size)
    keys = [
        F.when((size[i] + size[j] >= 2) & ((size[i] + size[j]) * 4 >= total), F.xxhash64(F.lit(n), block[i], block[j]))
        for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))
    ]
    return F.array_compact(F.array(*keys))


def _hashed(lines: DataFrame, min_words: int) -> DataFrame:
    """``(k1, k2, pos, raw, line_id, n, h1, h2, sizes)`` of every line with text.

    ``line_id`` stands for the words of a line (of one without words, for its characters), ``raw`` for the line as it
    is, ``n`` is the length of its words joined by blanks.  Lines too short for near copies have no SimHash.
    """
    bare = F.xxhash64(F.regexp_replace("line", r"\s+", ""))
    # The arrays of one element keep the words and hashes from being worked out once more for every mention.
    own = lines.where(F.col("line").rlike(r"\S"))
    own = own.select(*KEY, "pos", F.xxhash64("line").alias("raw"), bare.alias("bare"), F.explode_outer(F.array(words_of(F.col("line")))).alias("words"))
    n = F.length(F.array_join("words", " "))
    line_id = F.when(F.size("words") > 0, F.xxhash64("words")).otherwise(F.col("bare")).alias("line_id")
    enough = (F.size("words") > 0) & ((F.size("words") >= min_words) | (n >= MIN_CHARS))
    own = own.select(*KEY, "pos", "raw", line_id, n.alias("n"), F.explode_outer(F.array(F.when(enough, simhash(F.col("words"))))).alias("s"))
    return own.select(*KEY, "pos", "raw", "line_id", "n", "s.h1", "s.h2", "s.sizes")


def _apart(a: Column, b: Column) -> Column:
    """``struct<x, y>``: two lines without the words that both begin and end with; the edit distance stays the same."""

    def common(x: Column, y: Column) -> Column:
        """How many words two lists begin with alike."""
        same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
        first = F.array_position(same, False).cast("int")
        return F.when(first == 0, F.size(same)).otherwise(first - 1)

    def middle(words: Column, before: Column, after: Column) -> Column:
        return F.array_join(F.slice(words, before + 1, F.size(words) - before - after), " ")

    def cut(x: Column, y: Column) -> Column:
        def behind(n: Column) -> Column:
            # What the beginnings have taken is not there for the ends.
            rest = lambda w: F.reverse(F.slice(w, n + 1, F.size(w) - n))
            return let(common(rest(x), rest(y)), lambda m: F.struct(middle(x, n, m).alias("x"), middle(y, n, m).alias("y")))

        return let(common(x, y), behind)

    return let(F.split(a, " "), lambda x: let(F.split(b, " "), lambda y: cut(x, y)))


def _edited(both: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of ``(a, b, wa, wb)`` of which few enough characters have to be edited."""
    most = F.floor(F.greatest(F.length("wa"), F.length("wb")) * (100 - percent) / 100)
    both = both.select("a", "b", most.cast("int").alias("most"), F.explode_outer(F.array(_apart(F.col("wa"), F.col("wb")))).alias("m"))
    # What is left in the middle can be replaced as a whole; only if that is too much, its distance is worked out.  It
    # is -1 if it is larger than that.
    whole = F.greatest(F.length("m.x"), F.length("m.y"))
    distance = F.expr("levenshtein(m.x, m.y, most)")
    return both.where(F.when(whole <= F.col("most"), F.lit(True)).otherwise(distance >= 0)).select("a", "b")


# Letters that are counted before lines are compared.  An edited character changes the count of one letter by one, or of
# two letters, one up and one down.
_LETTERS = "etaoinsrhldcum"


def _letters(words: Column) -> list[Column]:
    """How often each of ``_LETTERS`` is in a line's words."""
    bare = lambda c: F.length(F.replace(words, F.lit(c), F.lit("")))
    return [(F.length(words) - bare(c)).alias(f"c{i}") for i, c in enumerate(_LETTERS)]


def _few_letters_apart(l: str, r: str, most: Column) -> Column:
    """Whether two lines can be ``most`` edits apart, by their letters."""

    def over(a: str, b: str) -> Column:
        more = [F.greatest(F.col(f"{a}.c{i}") - F.col(f"{b}.c{i}"), F.lit(0)) for i in range(len(_LETTERS))]
        return reduce(lambda x, y: x + y, more)

    return (over(l, r) <= most) & (over(r, l) <= most)


def _distance(a: str, b: str) -> Column:
    """In how many bits two SimHashes differ."""
    apart = lambda h: F.bit_count(F.col(f"{a}.{h}").bitwiseXOR(F.col(f"{b}.{h}")))
    return apart("h1") + apart("h2")


def line_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, percent: int = 80
) -> tuple[DataFrame, DataFrame]:
    """All lines with text ``(k1, k2, pos, line_id)``, and the group of each that is not alone ``(line_id, group)``."""
    lines = _lines(docs, id_col, text_col)
    hashed = stored(_hashed(lines, min_words), "line-hashes")
    # Equal words have equal hashes, so any of them will do; of lines with equal words, so will any.
    distinct = hashed.groupBy("line_id").agg(
        *[F.max(c).alias(c) for c in ("n", "h1", "h2", "sizes")], F.min("raw").alias("raw"), F.count(F.lit(1)).alias("copies")
    )
    distinct = stored(distinct, "distinct-lines")

    def may(x: Column, y: Column) -> Column:
        """Whether two lengths are near enough."""
        return F.abs(x - y) <= F.floor(F.greatest(x, y) * (100 - percent) / 100)

    def texts(ids: DataFrame) -> DataFrame:
        wanted = distinct.join(ids.withColumnRenamed("id", "line_id"), "line_id", "left_semi")
        wanted = stored(wanted.select(F.col("line_id").alias("id"), "raw"), "wanted-lines")
        own = lines.select(F.xxhash64("line").alias("raw"), "line").join(wanted.select("raw"), "raw", "left_semi")
        own = own.groupBy("raw").agg(F.first("line").alias("line"))
        found = own.join(wanted, "raw").select("id", F.array_join(words_of(F.col("line")), " ").alias("words"))
        found = stored(found, "line-texts")
        discard(wanted)
        return found

    def similar(pairs: DataFrame, table: DataFrame) -> DataFrame:
        hashes = lambda x: distinct.select(F.col("line_id").alias(x), F.struct("h1", "h2").alias(f"s{x}"))
        near = pairs.join(hashes("a"), "a").join(hashes("b"), "b").where(_distance("sa", "sb") <= MAX_DISTANCE).select("a", "b")
        side = lambda x: table.select(F.col("id").alias(x), F.col("words").alias(f"w{x}"))
        return _edited(near.join(side("a"), "a").join(side("b"), "b"), percent)

    keys = _block_keys(F.col("h1"), F.col("h2"), F.col("sizes"))
    lists = distinct.where("h1 is not null").select(F.explode(keys).alias("key"), F.col("line_id").alias("id"), "n")
    of_list = [F.count(F.lit(1)).alias("m"), F.min("n").alias("n1"), F.max("n").alias("n2")]
    worth = (F.col("m") > 2) | may(F.col("n1"), F.col("n2"))

    def marks(table: DataFrame) -> DataFrame:
        hashes = distinct.select(F.col("line_id").alias("id"), "h1", "h2")
        return table.select("id", *_letters(F.col("words"))).join(hashes, "id")

    def near(l: str, r: str) -> Column:
        most = F.floor(F.greatest(F.col(f"{l}.n"), F.col(f"{r}.n")) * (100 - percent) / 100)
        return (_distance(l, r) <= MAX_DISTANCE) & _few_letters_apart(l, r, most)

    close = lambda l, r: may(F.col(f"{l}.n"), F.col(f"{r}.n"))
    links = linked(lists, similar, texts, close, of_list, worth, marks, near)
    found = components(links).select(F.col("node").alias("line_id"), F.col("component").alias("group"))
    repeated = distinct.where("copies > 1").select("line_id").join(found, "line_id", "left_anti")
    groups = stored(found.unionByName(repeated.select("line_id", F.col("line_id").alias("group"))), "line-groups")
    discard(distinct, links)
    return hashed.select(*KEY, "pos", "line_id"), groups


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, percent: int = 80
) -> DataFrame:
    """``(k1, k2, gone)``: for each document with lines to go, their positions, counted from 0."""
    lines, groups = line_groups(docs, id_col, text_col, min_words, percent)
    grouped = lines.join(groups, "line_id")
    order = F.struct(*KEY, "pos")
    first = grouped.groupBy("group").agg(F.min(order).alias("first"))
    met = grouped.join(first.withColumnRenamed("group", "g"), F.col("group") == F.col("g"))
    gone = met.where(order != F.col("first")).select(*KEY, "pos")
    return gone.groupBy(*KEY).agg(F.collect_set("pos").alias("gone"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None, **options
) -> DataFrame:
    """The rows with the repeated lines taken out of their texts; rows of which nothing is left go.

    Two lines are linked if at most a fifth of the longer one has to be edited, their SimHashes agree in two blocks and
    differ in at most ``MAX_DISTANCE`` bits; lines of fewer than ``min_words`` words and of fewer than ``MIN_CHARS``
    characters only lose their exact copies (case and punctuation aside; of a line without words, white space aside).
    Lines with edits in most of their words can be missed.  A group is connected by links, and
    its first line by document id (null first), text hash and position stays.  Repeated rows (same id, same text)
    are one document: they lose the same lines.  Null and empty texts and texts without repeated lines stay as they
    are.  ``removed_col`` adds the number of lines taken out, and then keeps rows of which nothing is left.
    """
    gone = repeated_lines(docs, id_col, text_col, **options)
    gone = gone.select(F.col("__k1").alias("__g1"), F.col("__k2").alias("__g2"), F.col("gone").alias("__gone"))
    k1, k2 = row_key(id_col, text_col)
    met = docs.join(gone, (k1 == F.col("__g1")) & (k2 == F.col("__g2")), "left")

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(let(F.split(text_col, "\n"), rest))
    out = met.select(*[text.alias(c) if c == text_col else met[c] for c in docs.columns], "__gone")
    if removed_col is not None:
        return out.withColumn(removed_col, F.coalesce(F.array_size("__gone"), F.lit(0))).drop("__gone")
    return out.where(F.col("__gone").isNull() | (F.trim(text_col) != "")).drop("__gone")
