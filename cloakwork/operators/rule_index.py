"""Rule tables of any size: an index of literals says which rules to try on which text.

Up to a few hundred custom rules are compiled into the projection that scans every text; with tens of
thousands each text would pay for each rule.  Here every pattern gives literals that no match can lack, and one
gram of each of them goes into an index: the whole literal, or of a longer one those ``LONG_GRAM`` characters in a row
that fewest rules have, of those the ones least usual in text.  Texts are looked through for the same grams, ASCII letters
in lower case on both sides, and meet the index in a join; only rules that met a text are tried on it, in the same
scan as built-in ones.  So the cost of a text follows its length and the rules it meets, not the number of rules.

A gram's key is made of its first and last ``HEAD`` bytes (or ``SHORT``) and its size.  Tasks look at all places of a batch
of texts at once in numpy and ask a filter of fixed size (``FILTER_BITS`` at most) where a gram may begin, and there, for
every size that grams have, whether it may be one; only the keys of those are shuffled.  What the filter lets through
beside them finds no partner in the join, so it costs time at worst, not results.

Nothing of the rule table is collected but patterns without such a literal, patterns that may span lines and those
that ``literals_of`` does not fully understand: these are compiled into the projection like other custom rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.corpus import spread
from ..sources.patterns import runnable
from .catalogue import Rule, custom_rule, severity_of
from .detect import BOUND, RULE_DATA

GRAM, LONG_GRAM = 4, 16

# Bytes at either end of a gram that its key is made of, and of a gram that has fewer than HEAD.
HEAD, SHORT = 8, 4

# The largest filter, places of texts that are looked at at a time, and rules that one task reads.
FILTER_BITS, AT_ONCE, RULES_PER_TASK = 1 << 28, 1 << 20, 20_000

# Rules that have to be tried on every text; more than that are refused.
MAX_DIRECT = 2000

MET = "__cw_met"

# Characters from frequent to rare in prose and code, to prefer grams that few texts have.
_USUAL_FIRST = " etaoinsrhldcumfpgwybvk.,-_=:/\"'()0123456789xjqz"


class _Unknown(Exception):
    """A part of a pattern that is left to the library which runs it."""


@dataclass
class _Reader:
    """Reads a pattern from left to right."""

    pattern: str
    at: int = 0
    flags: set[str] = field(default_factory=set)

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self, n: int = 1) -> str:
        part = self.pattern[self.at : self.at + n]
        if len(part) < n:
            raise _Unknown
        self.at += n
        return part

    def match(self, expression: str) -> re.Match | None:
        found = re.compile(expression).match(self.pattern, self.at)
        if found:
            self.at = found.end()
        return found


# Escapes for single characters, for places without width, and for one character of a kind.
_CONTROL = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "a": "\a", "e": "\x1b"}
_PLACES, _KINDS = "bBAzZG", "dDwWsShHvV"


def _usable(literals: list[str]) -> bool:
    return bool(literals) and all(len(x) >= GRAM for x in literals)


def _either(reader: _Reader) -> list[str]:
    """Literals of which every match of alternatives holds one; none if there is no such set."""
    branches = [_sequence(reader)]
    while reader.peek() == "|":
        reader.take()
        branches.append(_sequence(reader))
    return [x for b in branches for x in b] if all(map(_usable, branches)) else []


def _sequence(reader: _Reader) -> list[str]:
    """The best set of literals of a sequence: the one whose shortest literal is the longest."""
    found: list[list[str]] = []
    run = ""

    def end() -> None:
        nonlocal run
        found.append([run])
        run = ""

    while reader.peek() and reader.peek() not in "|)":
        kind, value = _item(reader)
        least, once = _repeat(reader)
        if kind == "place":
            if not once:
                raise _Unknown
        elif kind == "char" and least:
            run += value
            if not once:
                end()
        else:
            end()
            if kind == "group" and least:
                found.append(value)
    end()
    return max(filter(_usable, found), key=lambda x: (min(map(len, x)), -len(x)), default=[])


def _repeat(reader: _Reader) -> tuple[int, bool]:
    """How often at least, and whether it is once."""
    many = reader.match(r"[*+?]|\{(\d{1,4})(,(\d{1,4})?)?\}")
    if not many:
        if reader.peek() == "{":
            raise _Unknown
        return 1, True
    least = int(many[1]) if many[1] else int(many[0] == "+")
    if many[3] and int(many[3]) < least:
        raise _Unknown
    reader.match("[?+]")
    return least, False


def _item(reader: _Reader) -> tuple[str, str | list[str]]:
    char = reader.take()
    if char == "(":
        return _group(reader)
    if char == "[":
        return _class(reader)
    if char == "\\":
        return _escape(reader)
    if char in "^$":
        return "place", ""
    if char == ".":
        return "any", ""
    if char in "*+?{":
        raise _Unknown
    return "char", char


def _group(reader: _Reader) -> tuple[str, str | list[str]]:
    look = False
    if reader.peek() == "?":
        head = reader.match(r"\?(?:(:)|(=|!|<=|<!)|<[A-Za-z][A-Za-z0-9]*>|([ismd]+)(:|\)))")
        if not head:
            raise _Unknown
        look = bool(head[2])
        if head[4] == ")":
            return "place", ""
    inner = _either(reader)
    if reader.take() != ")":
        raise _Unknown
    return ("place", "") if look else ("group", inner)


def _class(reader: _Reader) -> tuple[str, str]:
    """One character of a simple class; nested and intersected ones are left alone."""
    reader.match(r"\^")
    part = re.compile(rf"\\(?:[{_KINDS}]|[^A-Za-z0-9])|[^\\\[\]&]")
    members = []
    while reader.peek() != "]" or not members:
        found = part.match(reader.pattern, reader.at)
        if not found:
            raise _Unknown
        reader.at = found.end()
        members.append(found[0])
    reader.take()
    for low, dash, high in zip(members, members[1:], members[2:], strict=False):
        if dash == "-" and (len(low) > 1 or len(high) > 1 or low > high):
            raise _Unknown
    return "any", ""


def _escape(reader: _Reader) -> tuple[str, str]:
    quoted = reader.match(r"Q(.*?)\\E")
    if quoted:
        # A quantifier would repeat the last character only.
        if reader.peek() and reader.peek() in "*+?{":
            raise _Unknown
        return ("char", quoted[1]) if quoted[1] else ("place", "")
    number = reader.match(r"x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})")
    if number:
        return "char", chr(int(number[1] or number[2], 16))
    if reader.match(r"[pP](?:L|N|Lu|Ll|Nd|Alpha|Digit|Alnum|Upper|Lower|Punct|\{(?:L|N|Lu|Ll|Nd|Alpha|Digit|Alnum|Upper|Lower|Punct)\})"):
        return "any", ""
    char = reader.take()
    if char in _CONTROL:
        return "char", _CONTROL[char]
    if char in _PLACES:
        return "place", ""
    if char in _KINDS:
        return "any", ""
    if char.isalnum():
        raise _Unknown
    return "char", char


def literals_of(pattern: str) -> list[str] | None:
    """Literals of ``GRAM`` characters or more of which every match of a pattern holds at least one.

    Empty where there are none; null where the pattern is not fully understood.  ASCII letters may differ in case.
    """
    reader = _Reader(pattern)
    try:
        found = _either(reader)
    except (_Unknown, RecursionError):
        return None
    return found if reader.at == len(pattern) else None


def _lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def _commonness(gram: str) -> int:
    return sum(len(_USUAL_FIRST) - _USUAL_FIRST.find(c) for c in gram if c in _USUAL_FIRST)


def _grams(literal: str) -> set[str]:
    size = min(len(literal), LONG_GRAM)
    return {literal[k : k + size] for k in range(len(literal) - size + 1)}


def _mixed(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    """Hashes of pairs of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(y, np.uint64)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _windows(data: np.ndarray, width: int) -> np.ndarray:
    """The bytes from every place on as one number; ``data`` has ``HEAD`` bytes more than places."""
    return np.ndarray((len(data) - HEAD,), f"<u{width}", data, strides=(1,))


def _begins(windows: np.ndarray, width: int) -> np.ndarray:
    return _mixed(windows.astype(np.uint64), width)


def _keys(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    return _mixed(_mixed(first.astype(np.uint64), size << 8), last)


def _width(size: int) -> int:
    return HEAD if size >= HEAD else SHORT


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(HEAD, np.uint8)])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams with their size in bytes, their key and the hash of their beginning."""
    for batch in batches:
        sizes, keys, begins = [], [], []
        for gram in batch["gram"].to_pylist():
            data = np.frombuffer(gram.encode("utf-8", "surrogatepass"), np.uint8)
            size, width = len(data), _width(len(data))
            windows = _windows(_padded(data), width)
            sizes.append(size)
            keys.append(_keys(windows[:1], windows[size - width : size - width + 1], size)[0])
            begins.append(_begins(windows[:1], width)[0])
        made = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, begins)]
        yield pa.RecordBatch.from_arrays([batch["gram"], batch["order"], pa.array(sizes, pa.int32()), *made], names=["gram", "order", "size", "key", "begin"])


def _filter(grams: DataFrame) -> np.ndarray:
    """The keys and beginnings of grams as bits, 16 for each while there is room."""
    bits = min(FILTER_BITS, 1 << max(13, (32 * grams.count()).bit_length()))
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    hashes = grams.select(F.explode(F.array("key", "begin")).alias("hash")).select(F.shiftright(place, 3).alias("at"), place.bitwiseAND(F.lit(7)).alias("bit"))
    found = hashes.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1, int(bit))")).alias("byte")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[found["at"].to_numpy()] = found["byte"].to_numpy()
    return out


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _met_keys(texts: pa.Array, sizes: tuple[int, ...], bits: np.ndarray) -> pd.DataFrame:
    """The keys of grams that texts may hold, ``text, key``, each once a text."""
    body = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
    raw = np.frombuffer(body.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    data = _padded(_LOWER[raw])
    found: list[pd.DataFrame] = []
    for width in (HEAD, SHORT):
        own = [size for size in sizes if _width(size) == width]
        windows = _windows(data, width)
        for start in range(0, len(raw) if own else 0, AT_ONCE):
            at = start + np.flatnonzero(_holds(bits, _begins(windows[start : start + AT_ONCE], width)))
            text = np.searchsorted(ends, at, "right") - 1
            for size in own:
                # A gram ends in the text in which it begins.
                inside = at + size <= ends[text + 1]
                here = at[inside]
                keys = _keys(windows[here], windows[here + (size - width)], size)
                met = _holds(bits, keys)
                found.append(pd.DataFrame({"text": text[inside][met], "key": keys[met].view(np.int64)}))
    return pd.concat(found).drop_duplicates() if found else pd.DataFrame({"text": np.zeros(0, np.int64), "key": np.zeros(0, np.int64)})


def _literals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every literal of every rule its grams; a rule without any gives a row without."""
    kinds = {"order": pa.int64(), "literal": pa.int32(), "gram": pa.string(), "common": pa.int32()}
    for batch in batches:
        rows: list[tuple] = []
        for order, name, pattern in zip(*(batch[c].to_pylist() for c in ("order", "name", "pattern")), strict=True):
            found = None if custom_rule(name, pattern).multiline else literals_of(pattern)
            rows += [
                (order, i, gram, _commonness(gram))
                for i, literal in enumerate(found or [])
                for gram in _grams(_lower(literal))
            ] or [(order, None, None, None)]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


@dataclass(frozen=True)
class RuleIndex:
    """An indexed rule table: ``grams`` (gram, order, key), ``rules`` (order, rule), what is tried on every text,
    ``rejected`` patterns that are no regular expressions, the grams' ``sizes`` in bytes and their filter."""

    grams: DataFrame
    rules: DataFrame
    direct: tuple[Rule, ...]
    orders: tuple[int, ...]
    rejected: DataFrame
    sizes: tuple[int, ...]
    bits: Broadcast

    def met(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """Rules that may match, by hash of the text: ``h, met``.  Equal texts meet once they are grouped, within
        tasks first; a text is looked up in the index by its distinct grams."""
        sizes, bits = self.sizes, self.bits

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _met_keys(batch["text"], sizes, bits.value)
                hashes = batch["h"].take(pa.array(found["text"].to_numpy()))
                yield pa.RecordBatch.from_arrays([hashes, pa.array(found["key"].to_numpy())], names=["h", "key"])

        texts = df.select(F.xxhash64(text_col).alias("h"), F.col(f"`{text_col}`").alias("text"))
        cut = texts.mapInArrow(keys, "h long, key long")
        pairs = cut.join(self.grams.select("key", "order"), "key").select("h", "order").distinct()
        return pairs.join(self.rules, "order").groupBy("h").agg(F.sort_array(F.collect_list("rule")).alias("met"))

    def attach(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows with the rules to try on each, as column ``__cw_met``."""
        keep = [F.col(f"d.`{c}`") for c in df.columns]
        met = F.xxhash64(f"d.`{text_col}`") == F.col("m.h")
        joined = df.alias("d").join(self.met(df, text_col).alias("m"), met, "left")
        return joined.select(*keep, F.coalesce("m.met", F.array().cast(RULE_DATA)).alias(MET))


def rule_index(rules: DataFrame, order_col: str = "item") -> RuleIndex:
    """Index a table of rules ``(name, pattern, category)``; a smaller ``order_col`` wins where matches overlap, rows
    with equal ones go by name and pattern, and rows without a pattern are left out."""
    from ..session import stored

    spark = rules.sparkSession
    category = F.coalesce(F.col("category") if "category" in rules.columns else F.lit(None), F.lit("custom"))
    rows = rules.where("pattern <> ''").select(
        F.col(order_col).alias("key"), F.coalesce("name", F.lit("custom-pattern")).alias("name"), "pattern", category.alias("category")
    )
    numbered = spread(stored(_numbered(rows.distinct()), "rules"), RULES_PER_TASK)
    cut = stored(numbered.mapInArrow(_literals, "order long, literal int, gram string, common int"), "grams")
    sharing = cut.where("gram is not null").groupBy("gram").agg(F.count_distinct("order").alias("sharing"))
    best = F.min(F.struct("sharing", "common", "gram")).alias("best")
    grams = cut.join(sharing, "gram").groupBy("order", "literal").agg(best)
    chosen = grams.select(F.col("best.gram").alias("gram"), "order").distinct()
    grams = stored(chosen.mapInArrow(_keyed, "gram string, order long, size int, key long, begin long"), "index")

    alone = numbered.join(cut.where("gram is null").select("order"), "order").orderBy("order")
    rest = alone.select("order", "name", "pattern", "category").limit(MAX_DIRECT + 1).collect()
    if len(rest) > MAX_DIRECT:
        raise ValueError(f"more than {MAX_DIRECT} rules without a literal of {GRAM} characters")
    good = [(r, runnable(spark, r.pattern)) for r in rest]
    direct = [(r.order, custom_rule(r.name, pattern, r.category)) for r, pattern in good if pattern is not None]
    rejected = [(r.name, r.pattern, r.category) for r, pattern in good if pattern is None]

    data = F.struct(
        F.col("order").cast("int").alias("prio"), "name", "category", "pattern", F.lit(0).alias("group"), F.lit(0.5).alias("base"),
        _severity(F.col("category")).alias("severity"), F.lit(0.0).alias("min_entropy"),
        F.col("pattern").rlike(BOUND).alias("bound"),
    )
    return RuleIndex(
        grams,
        numbered.select("order", data.alias("rule")),
        tuple(rule for _, rule in direct),
        tuple(order for order, _ in direct),
        spark.createDataFrame(rejected, "name string, pattern string, category string"),
        tuple(sorted(r[0] for r in grams.select("size").distinct().collect())),
        spark.sparkContext.broadcast(_filter(grams)),
    )


def _numbered(rules: DataFrame) -> DataFrame:
    """Rules with a running number from 0: sorted by ranges and counted in each, the ranges before it added."""
    from ..session import stored

    ordered = rules.orderBy("key", "name", "pattern", "category").withColumn("at", F.monotonically_increasing_id())
    ordered = stored(ordered, "sorted-rules").withColumn("part", F.shiftright("at", 33))
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(before, "part").select((F.col("before") + within).cast("long").alias("order"), "name", "pattern", "category")


def _severity(category: Column) -> Column:
    from .catalogue import CATEGORIES

    known = F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c, severity_of(c))])
    return F.coalesce(F.element_at(known, category), F.lit(severity_of("")))
