"""Collocations: phrases of two to four words that stand together more often than their parts let expect.

Everything is counted for each language on its own, over whole texts.  ``f`` counts occurrences, overlaps included;
cutting a phrase of ``a`` occurrences into two parts of ``l`` and ``r`` scores ``2000000 a / (l + r)``, and the
lowest cut counts.  A phrase goes when a longer one that holds it has four fifths of its occurrences; the longer one
may be taken to be one word longer, since a phrase occurs no more often than its parts.

Phrases grow best first.  However a phrase goes on, it occurs no more often than its beginning, so no continuation of
a beginning with count ``f`` and first word of count ``l`` can score above ``2000000 f / (l + f)``: the bound.  Each
language has a limit; beginnings whose bound reaches it are grown, the others wait.  As every phrase that scores the
limit or more has been grown then, and every longer phrase that could remove it has been counted, the survivors from the
limit up are settled.  Where they are fewer than asked for, the limit of that language goes down, to zero at
last, and the waiting beginnings are grown.

Counting is a pass over the texts.  Tasks count what a batch of texts holds and send sums.  Which phrases may
be counted is asked of filters of fixed size (two bits a phrase, ``FILTER_BYTES`` at most), which say yes to all that
may and to some others; the sums of those are dropped afterwards, so filters cost time at worst, not results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

MIN_COUNT, LONGEST, TOP = 30, 4, 2000
SCALE, SHARE = 2_000_000, 80
NO_LANGUAGE = "und"

# What separates the pieces of a text; blanks and tabs separate words.
PIECES = r"[.,;:!?\x0A-\x0D]"

# Text that is counted at a time, in bytes, and the largest filter.
AT_ONCE, FILTER_BYTES = 6 << 20, 1 << 25

# Phrases that the first limit of a language lets grow, in multiples of those asked for; each further round takes
# GROWTH times as many.
FIRST, GROWTH = 4, 4

_COUNT = "lang string, phrase string, c long"
_BREAK = "\n"


# Filters


class Filter:
    """Hashes of phrases as bits; says yes to every phrase in it."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in _places(hashes, len(self.bits) * 8):
            found &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return found


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two bits for every hash; ``bits`` is a power of two."""
    mask = np.uint64(bits - 1)
    other = ((hashes >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return [(hashes & mask).astype(np.int64), (other & mask).astype(np.int64)]


def _hashes(texts: pa.Array) -> np.ndarray:
    return pd.util.hash_array(texts.to_numpy(zero_copy_only=False), categorize=False)


def _joined(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase one word longer; that of no words is its language's."""
    x = (left ^ (left >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    words = pc.split_pattern(phrases, " ")
    flat, starts = _hashes(words.flatten()), words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    out = _hashes(langs)
    for i in range(sizes.max(initial=0)):
        more = sizes > i
        out[more] = _joined(out[more], flat[starts[more] + i])
    return out


def filter_of(phrases: DataFrame) -> Filter:
    """A filter of ``(lang, phrase)`` rows, of 16 bits a phrase while there is room.  Tasks set the bits of one block
    each, so what comes to the driver, and goes out again, is ``FILTER_BYTES`` at most."""
    size = min(FILTER_BYTES, 1 << max(13, (2 * phrases.count()).bit_length()))
    block = min(size, 1 << 16)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = phrase_hashes(batch["lang"], batch["phrase"])
            place = np.concatenate(_places(hashes, size * 8))
            yield pa.RecordBatch.from_pydict({"block": pa.array(place // (block * 8)), "place": pa.array(place % (block * 8))})

    def packed(table: pa.Table) -> pa.Table:
        bits = np.zeros(block * 8, bool)
        bits[table["place"].to_numpy()] = True
        return pa.table({"block": table["block"].slice(0, 1), "body": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    blocks = phrases.select("lang", "phrase").mapInArrow(places, "block long, place long")
    out = np.zeros(size, np.uint8)
    for row in blocks.groupBy("block").applyInArrow(packed, "block long, body binary").toLocalIterator():
        out[row.block * block : (row.block + 1) * block] = np.frombuffer(row.body, np.uint8)
    return Filter(out)


# Counting


class Words:
    """The words of some texts as numbers, one for every word of a language, with breaks between pieces."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        own = langs.dictionary_encode()
        apart = pc.replace_substring_regex(pc.ascii_lower(texts), PIECES, f" {_BREAK} ")
        apart = pc.binary_join_element_wise(pc.replace_substring(apart, "\t", " "), _BREAK, " ")
        lists = pc.split_pattern(apart, " ")
        flat = lists.flatten().dictionary_encode()
        names = flat.dictionary
        code = flat.indices.to_numpy().astype(np.int64)
        lang = np.repeat(own.indices.to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()))
        blank, gap = (pc.equal(names, x).to_numpy(zero_copy_only=False)[code] for x in ("", _BREAK))
        key = np.where(gap, -1, lang * len(names) + code)[~blank]
        self.code, keys = pd.factorize(key)
        self.word = key >= 0
        # The break has a number too, and some language and name, which nothing asks for.
        self.name, self.lang = keys % len(names), np.maximum(keys, 0) // len(names)
        self.names, self.langs = names, own.dictionary

    def _called(self, codes: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(self.name[codes]))

    def _spoken(self, codes: np.ndarray) -> pa.Array:
        return self.langs.take(pa.array(self.lang[codes]))

    def totals(self) -> dict[str, pa.Array]:
        """Every word with its count, and all words of a language under the empty one."""
        counts = np.bincount(self.code[self.word], minlength=len(self.name))
        there = np.flatnonzero(counts)
        whole = np.bincount(self.lang, weights=counts, minlength=len(self.langs)).astype(np.int64)
        return {
            "lang": pa.concat_arrays([self._spoken(there), self.langs]),
            "phrase": pa.concat_arrays([self._called(there), pa.array([""] * len(whole), pa.string())]),
            "c": pa.array(np.append(counts[there], whole), pa.int64()),
        }

    def phrases(self, size: int, may: dict[str, Filter]) -> dict[str, pa.Array]:
        """Phrases of ``size`` words with their counts.  Of the filters in ``may``, ``words`` and ``pairs`` have to hold
        all words and pairs in a phrase, ``whole`` the phrase; ``begin`` has to hold all but its last
        word, or ``end`` all but its first."""
        single = _hashes(self.names)[self.name]
        hashes = _joined(_hashes(self.langs)[self.lang], single)
        ids, here = self.code, self.word & may["words"].holds(hashes)[self.code]
        first = np.empty(0, np.int64)
        for k in range(2, size + 1):
            both = here[:-1] & here[1:]
            if k == size and "begin" in may:
                both &= may["begin"].holds(hashes)[ids[:-1]] | may["end"].holds(hashes)[ids[1:]]
            at = np.flatnonzero(both)
            new, _ = pd.factorize(ids[at] * len(single) + self.code[at + k - 1])
            first = np.empty(new.max(initial=-1) + 1, np.int64)
            first[new[::-1]] = at[::-1]
            hashes = _joined(hashes[ids[first]], single[self.code[first + k - 1]])
            good = np.ones(len(first), bool)
            for name in [n for n, there in (("pairs", k == 2), ("whole", k == size)) if there and n in may]:
                good &= may[name].holds(hashes)
            kept = good[new]
            at, new = at[kept], new[kept]
            ids = np.zeros(len(self.code), np.int64)
            ids[at] = new
            here = np.zeros(len(self.code), bool)
            here[at] = True
        counts = np.bincount(new, minlength=len(first))
        there = np.flatnonzero(counts)
        words = [self.code[first[there] + i] for i in range(size)]
        phrase = pc.binary_join_element_wise(*[self._called(w) for w in words], " ")
        return {"lang": self._spoken(words[0]), "phrase": phrase, "c": pa.array(counts[there], pa.int64())}


_PIECE_END, _BLANK = re.compile(PIECES), re.compile(r"[\x20\x09]")


def cut(text: str, size: int, at_once: int) -> Iterator[str]:
    """A long text in parts that together hold each phrase of ``size`` words as often as the whole.

    Parts end between pieces; inside a very long piece the next part begins ``size - 1`` words early: enough for the
    phrases across the cut, too few for any phrase to be in both.
    """
    at = 0
    while len(text) - at > at_once:
        end = _PIECE_END.search(text, at + at_once, at + 2 * at_once)
        if end:
            yield text[at : end.end()]
            at = end.end()
            continue
        blank = _BLANK.search(text, at + at_once)
        while blank and (back := _words_before(text, at, blank.start(), size - 1)) <= at:
            blank = _BLANK.search(text, blank.end())
        if not blank:
            break
        yield text[at : blank.start()]
        at = back
    yield text[at:]


def _words_before(text: str, low: int, high: int, n: int) -> int:
    """Where the last ``n`` words between two places begin, or the lower place if there are no more of them."""
    for _ in range(n):
        high = low + len(text[low:high].rstrip(" \t"))
        high = max(low, text.rfind(" ", low, high) + 1, text.rfind("\t", low, high) + 1)
    return high


def _parts(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Parts of a batch of about AT_ONCE bytes."""
    lengths = pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
        langs, texts = batch["lang"].slice(at, end - at), batch["text"].slice(at, end - at)
        if lengths[at] > AT_ONCE:
            for part in cut(texts[0].as_py(), size, AT_ONCE):
                yield langs, pa.array([part], pa.string())
        else:
            yield langs, texts
        at = end


def counted(texts: DataFrame, size: int, may: dict[str, Filter], least: int) -> DataFrame:
    """``(lang, phrase, c)`` for phrases of ``size`` words that the filters let pass and that occur often enough; for
    single words also the number of all words of a language, under the empty phrase."""
    filters = {name: texts.sparkSession.sparkContext.broadcast(f.bits) for name, f in may.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {name: Filter(bits.value) for name, bits in filters.items()}
        for batch in batches:
            for langs, part in _parts(batch, size):
                words = Words(langs, part)
                yield pa.RecordBatch.from_pydict(words.totals() if size == 1 else words.phrases(size, own))

    found = texts.mapInArrow(run, _COUNT).groupBy("lang", "phrase").agg(F.sum("c").alias("c"))
    return stored(found.where((F.col("c") >= least) | (F.col("phrase") == "")), f"phrases-{size}")


# Scores


def _words(first: int | Column, count: int | Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, count), " ")


def _score(a: str, parts: str) -> Column:
    """Exact also where the product passes 64 bits."""
    return F.expr(f"cast({SCALE} as decimal(38, 0)) * {a} div ({parts})")


def with_bound(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """Phrases with the bound of what they can grow to."""
    one = known.select("lang", F.col("phrase").alias("head"), F.col("c").alias("first"))
    met = phrases.withColumn("head", _words(1, 1)).join(one, ["lang", "head"])
    return met.withColumn("bound", _score("c", "first + c")).drop("head", "first")


def scored(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """Phrases ``(lang, phrase, c)`` as ``(lang, phrase, a, l, r, score)``, by the cut with the lowest score.  Cuts with
    a part that is not known are left out."""
    size = F.size(F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", F.col("c").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", _words(1, F.col("k")).alias("left"), _words(F.col("k") + 1, F.size(F.split("phrase", " "))).alias("right"))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("c").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("c").alias("r"))
    met = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    best = F.min(F.struct(_score("a", "l + r").alias("score"), "k", "l", "r")).alias("best")
    return met.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def uncovered(phrases: DataFrame, longer: DataFrame, size: int) -> DataFrame:
    """Phrases of ``size`` words that no phrase one word longer takes four fifths of the occurrences of."""
    inside = longer.select("lang", "c", F.explode(F.array(_words(1, size), _words(2, size))).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("c").alias("most"))
    met = phrases.join(most, ["lang", "phrase"], "left")
    return met.where(F.coalesce(100 * F.col("most") < SHARE * F.col("a"), F.lit(True))).drop("most")


def _limits(pairs: DataFrame, wanted: int) -> DataFrame:
    """For each language the score that ``wanted`` pairs reach, or zero.  A language has a million scores at most."""
    each = pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score")))
    best = F.max(F.when(F.col("above") >= wanted, F.col("score")))
    return each.withColumn("above", above).groupBy("lang").agg(F.coalesce(best, F.lit(0)).alias("limit"))


def _settled(texts: DataFrame, words: DataFrame, pairs: DataFrame, limits: DataFrame, may: dict[str, Filter], least: int) -> DataFrame:
    """All surviving phrases that score their language's limit or more."""
    known = words.unionByName(pairs.select("lang", "phrase", F.col("a").alias("c")))
    texts = texts.join(limits.select("lang"), "lang", "left_semi")
    two = pairs.join(limits, "lang")
    best2 = two.where("score >= limit")
    may3 = may | {"begin": filter_of(two.where("bound >= limit")), "end": filter_of(best2)}
    three = counted(texts, 3, may3, least)
    best3 = stored(scored(three, known).join(limits, "lang").where("score >= limit"), "best-3")
    grow3 = stored(with_bound(three, words).join(limits, "lang").where("bound >= limit"), "grow-3")
    four = counted(texts, 4, may | {"begin": filter_of(grow3), "end": filter_of(best3)}, least)

    # Longer ends may be unknown: those of phrases that can still reach the limit are counted.
    grown = four.withColumn("phrase4", F.col("phrase")).withColumn("phrase", _words(1, 3))
    grown = grown.join(grow3.select("lang", "phrase", "limit"), ["lang", "phrase"]).drop("phrase")
    grown = with_bound(grown.withColumnRenamed("phrase4", "phrase"), words).where("bound >= limit")
    known = known.unionByName(three)
    so_far = scored(grown.select("lang", "phrase", "c"), known).join(limits, "lang").where("score >= limit")
    so_far = stored(so_far.select("lang", "phrase", F.col("a").alias("c"), "limit"), "maybe-4")
    ends = so_far.select("lang", _words(2, 3).alias("phrase")).distinct().join(three, ["lang", "phrase"], "left_anti")
    ends = stored(ends, "ends-3")
    if not ends.isEmpty():
        known = known.unionByName(counted(texts, 3, may | {"whole": filter_of(ends)}, least).join(ends, ["lang", "phrase"], "left_semi"))
    best4 = scored(so_far.select("lang", "phrase", "c"), known).join(limits, "lang").where("score >= limit")

    columns = ["lang", "phrase", "a", "l", "r", "score"]
    kept = uncovered(best2, three, 2).select(columns).unionByName(uncovered(best3, four, 3).select(columns))
    return stored(kept.unionByName(best4.select(columns)), "settled")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Ordered by score and count, largest first, then by the bytes of the phrase; ``n`` counts the language's words.
    ASCII letters count in lower case.  A missing language is ``und``, a missing text empty; repeated rows count each
    time; an empty table, or one without frequent phrases, gives an empty one; other columns are not read.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    texts = docs.select(lang, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    single = counted(texts, 1, {}, least)
    words, totals = single.where("phrase <> ''"), single.where("phrase = ''").select("lang", F.col("c").alias("n"))
    may = {"words": filter_of(words)}
    two = counted(texts, 2, may, least)
    bounds = with_bound(two, words).select("lang", "phrase", "bound")
    pairs = stored(scored(two, words).join(bounds, ["lang", "phrase"]), "pairs")
    may["pairs"] = filter_of(pairs)

    done, left, wanted = None, pairs, FIRST * top
    while not left.isEmpty():
        limits = stored(_limits(left, wanted), "limits")
        found = _settled(texts, words, left, limits, may, least)
        enough = found.groupBy("lang").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= top)
        whole = limits.join(enough, "lang", "left").where("found is not null or limit = 0").select("lang")
        whole = stored(whole, "whole")
        settled = found.join(whole, "lang", "left_semi")
        done = settled if done is None else done.unionByName(settled)
        left = left.join(whole, "lang", "left_anti")
        wanted *= GROWTH
    if done is None:
        done = pairs.select("lang", "phrase", "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = done.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
