"""Repair of the structure of conversations at least cost.

A conversation is a row of turns.  Its faults are counted, and the cheapest edits are found that turn the initials
of its roles into ``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert of an empty turn 5; a
blank or repeated turn has to go, a truncated one that stays costs 5 more.  Of equally cheap edits those stand whose
initials (D, I, K, R, in the order of the turns) come first in the alphabet.

What a turn can do depends on its symbol alone (initial of the role, truncated or not, or to be deleted), and the
costs of what may follow are a vector over the four states of the pattern.  Less its smallest entry that vector takes
few values, so for every block of ``BLOCK`` symbols the step from the vector behind it to the vector before it is
tabulated once.  Conversations go backward through that table, a lookup for a block, many conversations at a
time; then each block is expanded backward into the vectors between its turns, and the edits are read off forward,
first letter first, which settles ties.

Conversations of up to ``LONG_ROWS`` turns and ``LONG_CHARS`` characters are dealt by their keys and solved in
streams of sorted rows.  Longer ones are dealt by ranges of turns: a task reduces its stretch to one byte a turn and
tabulates what the stretch does to every vector and state; these tables are chained for each conversation, then the
stretches are traced side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

# Turns in a block of the table.
BLOCK = 4

# A conversation beyond either is cut into stretches of at most STRETCH turns.
LONG_ROWS, LONG_CHARS, STRETCH = 4096, 1 << 20, 1 << 15

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

WHITE = " \t\n\x0b\x0c\r"

# Symbols: initials s, u, a, other; the same truncated; to be deleted; nothing, which fills the first block.
GONE, NOTHING, SYMBOLS = 8, 9, 10

# The states of the pattern: nothing yet, a system turn, a user turn, an assistant turn.
_STATES = 4
_TAKES = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
_NEXT = [2, 2, 3, 2]  # by inserting or reroling the one turn that may follow
_ENDS = {0: "", 1: "II", 2: "I", 3: ""}
_FAR = 1 << 20

_RESULT = (
    "conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string, repaired array<struct<role string, text string>>"
)


def _before(after: np.ndarray, symbol: int) -> np.ndarray:
    """Costs from before a turn, by state, from those behind it."""
    if symbol == NOTHING:
        return after
    w = after + DELETE
    if symbol != GONE:
        more, role = (TRUNCATED, symbol - 4) if symbol >= 4 else (0, symbol)
        for state in range(_STATES):
            if (state, role) in _TAKES:
                w[state] = min(w[state], KEEP + more + after[_TAKES[state, role]])
            w[state] = min(w[state], REROLE + more + after[_NEXT[state]])
    return _with_inserts(w)


def _with_inserts(w: np.ndarray) -> np.ndarray:
    v = w.copy()
    v[2], v[3] = min(w[2], INSERT + w[3]), min(w[3], INSERT + w[2])
    v[0], v[1] = min(w[0], INSERT + v[2]), min(w[1], INSERT + v[2])
    return v


def _first_edits(after: np.ndarray, symbol: int, state: int) -> tuple[str, int]:
    """The cheapest edits up to and with a turn that come first in the alphabet, and the state behind them."""
    if symbol == NOTHING:
        return "", state
    v = _before(after, symbol)
    if v[state] == DELETE + after[state]:
        return "D", state
    if v[state] == INSERT + v[_NEXT[state]]:
        edits, end = _first_edits(after, symbol, _NEXT[state])
        return "I" + edits, end
    more, role = (TRUNCATED, symbol - 4) if symbol >= 4 else (0, symbol)
    if (state, role) in _TAKES and v[state] == KEEP + more + after[_TAKES[state, role]]:
        return "K", _TAKES[state, role]
    return "R", _NEXT[state]


class Tables:
    """Steps between normalised cost vectors, for single symbols and for blocks, and the edits of every step."""

    def __init__(self, block: int = BLOCK):
        end = _with_inserts(np.asarray([0, _FAR, _FAR, 0]))
        number, vectors, steps = {tuple(end): 0}, [end], []
        for vector in vectors:  # grows while new vectors turn up
            for symbol in range(SYMBOLS):
                v = _before(vector, symbol)
                low = int(v.min())
                key = tuple(v - low)
                if key not in number:
                    number[key] = len(vectors)
                    vectors.append(v - low)
                steps.append((number[key], low))
        n = len(vectors)
        self.vectors = np.asarray(vectors)
        self.next1 = np.asarray([s for s, _ in steps], np.int32).reshape(n, SYMBOLS)
        self.add1 = np.asarray([a for _, a in steps], np.int32).reshape(n, SYMBOLS)

        spelt: dict[str, int] = {}
        edits = [_first_edits(v, s, q) for v in vectors for s in range(SYMBOLS) for q in range(_STATES)]
        self.edit = np.asarray([spelt.setdefault(e, len(spelt)) for e, _ in edits], np.int32).reshape(n, SYMBOLS, _STATES)
        self.state = np.asarray([q for _, q in edits], np.int32).reshape(n, SYMBOLS, _STATES)
        self.edits = list(spelt)

        # A block one symbol longer: the symbol in front acts last.
        self.block, self.next, self.add = block, np.arange(n, dtype=np.int32)[:, None], np.zeros((n, 1), np.int32)
        for _ in range(block):
            ahead = [self.next1[self.next, s] for s in range(SYMBOLS)]
            total = [self.add + self.add1[self.next, s] for s in range(SYMBOLS)]
            self.next, self.add = np.concatenate(ahead, axis=1), np.concatenate(total, axis=1)

    def blocks(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Conversations, given by where each begins, as whole blocks filled up in front: the symbols by block, the
        number of each block, where each conversation's blocks begin, and where its turns stand in them."""
        sizes = np.diff(np.append(starts, len(symbols)))
        count = -(-sizes // self.block)
        first = np.cumsum(count) - count
        filled = np.full(int(count.sum()) * self.block, NOTHING, np.int64)
        shift = (first + count) * self.block - (starts + sizes)
        at = np.arange(len(symbols)) + np.repeat(shift, sizes)
        filled[at] = symbols
        rows = filled.reshape(-1, self.block)
        return rows, rows @ (SYMBOLS ** np.arange(self.block)[::-1]), np.append(first, count.sum()), at

    def solve(self, symbols: np.ndarray, starts: np.ndarray, vector: int = 0, state: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least costs of conversations, the number of the edits of every turn, and the last states.

        ``vector`` is what follows each and ``state`` where each begins.
        """
        rows, numbers, first, at = self.blocks(symbols, starts)
        count = np.diff(first)
        order = np.argsort(-count, kind="stable")
        left = np.searchsorted(-count[order], -np.arange(count.max(initial=0)), side="left")
        v, cost = np.full(len(starts), vector, np.int32), np.zeros(len(starts), np.int64)
        behind = np.zeros(len(numbers), np.int32)
        for back, n in enumerate(left):
            now = order[:n]
            block = first[now + 1] - 1 - back
            behind[block] = v[now]
            cost[now] += self.add[v[now], numbers[block]]
            v[now] = self.next[v[now], numbers[block]]
        cost += self.vectors[v, state]
        after = self._expanded(rows, behind).ravel()[at]

        sizes = np.diff(np.append(starts, len(symbols)))
        order = np.argsort(-sizes, kind="stable")
        left = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
        q, edits = np.full(len(starts), state, np.int32), np.zeros(len(symbols), np.int32)
        for i, n in enumerate(left):
            now = order[:n]
            turn = starts[now] + i
            place = after[turn], symbols[turn], q[now]
            edits[turn] = self.edit[place]
            q[now] = self.state[place]
        return cost, edits, q

    def _expanded(self, rows: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """The vector behind every turn, from those behind the blocks."""
        after = np.empty((len(rows), self.block, *behind.shape[1:]), np.int32)
        for i in reversed(range(self.block)):
            after[:, i] = behind
            symbol = rows[:, i] if behind.ndim == 1 else rows[:, i, None]
            behind = self.next1[behind, symbol]
        return after

    def effect(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a stretch does: for every vector behind it the vector before it and the cost between, and for every
        vector behind and state before it the state behind."""
        rows, numbers, _, at = self.blocks(symbols, np.zeros(1, np.int64))
        v, cost = np.arange(len(self.vectors), dtype=np.int32), np.zeros(len(self.vectors), np.int64)
        behind = np.empty((len(numbers), len(v)), np.int32)
        for block in reversed(range(len(numbers))):
            behind[block] = v
            cost += self.add[v, numbers[block]]
            v = self.next[v, numbers[block]]
        after = self._expanded(rows, behind).reshape(-1, len(v))[at]
        q = np.tile(np.arange(_STATES, dtype=np.int32), (len(v), 1))
        for i, symbol in enumerate(symbols):
            q = self.state[after[i][:, None], symbol, q]
        return v, cost, q


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def audit_of(edits: np.ndarray, state: int) -> str:
    """The letters of a conversation's edits."""
    names = tables().edits
    return "".join([names[e] for e in edits]) + _ENDS[int(state)]


class _Repaired:
    """Follows an audit and says which turns come out."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _insert(self) -> tuple[str, str]:
        role = "assistant" if self.state == 2 else "user"
        self.state = _NEXT[self.state]
        return role, ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        while self.audit[self.at] == "I":
            self.at += 1
            yield self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _TAKES[self.state, "sua".index(role[:1])]
            yield role, text
        elif edit == "R":
            yield self._insert()[0], text

    def end(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit):
            self.at += 1
            yield self._insert()


# Turns as columns


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def faults(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it ends in other than a sentence's mark."""
    end = F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)
    return end == "", ~end.isin("", ".", "!", "?")


def _turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with what orders and tells them apart; missing roles and texts are one blank."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    blank, truncated = faults(F.col("text"))
    of_role = F.position(initial(F.col("role")), F.lit("sua"))
    symbol = F.when(blank, GONE).otherwise(
        F.when((of_role > 0) & (F.col("role") != ""), of_role - 1).otherwise(3) + F.when(truncated, 4).otherwise(0)
    )
    return rows.select(
        "conv_id", "turn", F.md5(F.concat(F.md5("role"), "text")).alias("h"), "role", "text",
        symbol.cast("byte").alias("symbol"), initial(F.col("role")).alias("initial"),
    )


def repair(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    with_turns: bool = True,
    long_rows: int = LONG_ROWS,
    long_chars: int = LONG_CHARS,
    stretch: int = STRETCH,
) -> DataFrame:
    """One row for every conversation: ``conv_id``, its ``gaps`` (numbers missing between the first and the last
    turn), ``blank``, ``duplicate``, ``truncated`` turns, ``illegal`` neighbours, least ``cost``, the ``audit`` of its
    edits, ``repaired_sha256`` of its repaired ``role:text`` lines and, unless ``with_turns`` is off, the ``repaired``
    turns (null where the
    conversation is longer than ``long_rows`` or ``long_chars``; its audit says what to do with each turn in order).

    Turns go by number, missing numbers first, equal numbers by a hash of role and text; a missing conversation key is
    a key of its own; missing roles and texts count as one blank, so that such texts are blank and such roles fit
    nowhere.  Repeated rows are repeated turns.  An empty table gives an empty one; other columns are not read.
    """
    rows = _turns(turns, conv, turn, role, text)
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    # At most a LONG_ROWS-th of the turns, and most often none.
    long = stored(sizes.where((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select("conv_id"), "long")
    kind = turns.schema[conv].dataType.simpleString()
    result = _RESULT.format(conv=kind)
    met = F.col("rows.conv_id").eqNullSafe(F.col("long.conv_id"))
    short = rows.alias("rows").join(long.alias("long"), met, "left_anti")
    short = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "h")
    done = short.mapInArrow(_stream(result, with_turns), result)
    if long.isEmpty():
        return done
    return done.unionByName(_long(rows.alias("rows").join(long.alias("long"), met, "left_semi"), kind, stretch))


def _cuts(values: pa.Array) -> np.ndarray:
    """Where a sorted column's values begin."""
    codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)


def _stream(result: str, with_turns: bool):
    """Solve conversations from sorted turns; the last one of a batch waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([waiting, table]).combine_chunks() if waiting is not None else table
            last = int(_cuts(table["conv_id"].combine_chunks())[-1])
            if last:
                yield _solved(table.slice(0, last).combine_chunks(), with_turns)
            waiting = table.slice(last)
        if waiting is not None:
            yield _solved(waiting.combine_chunks(), with_turns)

    return run


def _counts(table: pa.Table, starts: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Faults of sorted conversations, and the symbols of their turns."""
    n = table.num_rows
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    symbols = table["symbol"].to_numpy().astype(np.int64)
    blank = symbols == GONE
    seen = pd.DataFrame({"of": of, "h": pd.factorize(table["h"].to_numpy())[0]}).duplicated().to_numpy()
    duplicate = seen & ~blank
    symbols = np.where(duplicate, GONE, symbols)
    truncated = (symbols >= 4) & (symbols < GONE)
    first = np.zeros(n, bool)
    first[starts] = True
    pairs = _illegal(table["initial"]) & ~first
    there = table["turn"].is_valid().to_numpy()
    turn = table["turn"].fill_null(0).to_numpy()
    new = there & (first | ~np.append(False, there[:-1]) | np.append(True, turn[1:] != turn[:-1]))
    low = np.full(len(starts), np.iinfo(np.int64).max)
    high = np.full(len(starts), np.iinfo(np.int64).min)
    np.minimum.at(low, of[there], turn[there])
    np.maximum.at(high, of[there], turn[there])
    total = lambda x: np.bincount(of, weights=x, minlength=len(starts)).astype(np.int64)
    distinct = total(new)
    gaps = np.where(distinct > 0, np.where(distinct > 0, high - low, 0) + 1 - distinct, 0)
    counts = {"gaps": gaps, "blank": total(blank), "duplicate": total(duplicate), "truncated": total(truncated), "illegal": total(pairs)}
    return counts, symbols


def _illegal(initials: pa.ChunkedArray) -> np.ndarray:
    """Whether a turn may not stand behind the one before it in the table."""
    own = initials.to_numpy(zero_copy_only=False)
    code = np.select([own == "s", own == "u", own == "a"], [1, 2, 3], 0)
    before = np.append(0, code[:-1])
    return ~(((before == 1) & (code == 2)) | ((before == 2) & (code == 3)) | ((before == 3) & (code == 2)))


def _solved(table: pa.Table, with_turns: bool) -> pa.RecordBatch:
    starts = _cuts(table["conv_id"].combine_chunks())
    counts, symbols = _counts(table, starts)
    cost, edits, states = tables().solve(symbols, starts)
    roles, texts = table["role"].to_pylist(), table["text"].to_pylist()
    audits, digests, turns = [], [], []
    for a, b, state in zip(starts, np.append(starts[1:], len(symbols)), states, strict=True):
        audit = audit_of(edits[a:b], state)
        own = _Repaired(audit)
        out = [t for i in range(a, b) for t in own.turn(roles[i], texts[i])] + list(own.end())
        audits.append(audit)
        digests.append(hashlib.sha256("\n".join([f"{r}:{t}" for r, t in out]).encode()).hexdigest())
        turns.append([{"role": r, "text": t} for r, t in out] if with_turns else None)
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    columns = {"conv_id": table["conv_id"].combine_chunks().take(pa.array(starts))}
    columns |= {k: pa.array(v, pa.int64()) for k, v in counts.items()} | {"cost": pa.array(cost, pa.int64())}
    columns |= {"audit": pa.array(audits, pa.string()), "repaired_sha256": pa.array(digests, pa.string())}
    return pa.RecordBatch.from_pydict(columns | {"repaired": pa.array(turns, kind)})


# Long conversations

_STRETCH = (
    "conv_id {conv}, task int, nth int, symbols binary, vector binary, cost binary, state binary, first_initial string, "
    "last_initial string, illegal long, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long"
)
_CHAINED = (
    "conv_id {conv}, task int, nth int, behind int, state int, gaps long, blank long, duplicate long, truncated long, "
    "illegal long, cost long"
)
_PART = "conv_id {conv}, kind int, task int, nth int, turn long, h string, role string, text string"


def _long(rows: DataFrame, kind: str, stretch: int) -> DataFrame:
    """Conversations of any length.  Equal turns are counted before they are shuffled; the stretches of a conversation
    meet as tables of some kilobytes each.  The digest of a conversation is made by one task, which reads its turns
    in order and keeps none: a hash has to be worked out from its first byte to its last."""
    turn = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    light = rows.groupBy("conv_id", "turn", "h", "symbol", "initial").agg(F.count(F.lit(1)).alias("copies"))
    light = stored(light, "turns")
    first = light.groupBy("conv_id", "h").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = F.col("l.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("l.h") == F.col("f.h"))
    seen = light.alias("l").join(first.alias("f"), met, "left")
    later = F.coalesce(turn_of("l") > F.col("f.first"), F.lit(False))
    marked = seen.select("l.conv_id", "l.turn", "l.h", "symbol", "initial", "copies", later.alias("later"))
    dealt = marked.repartitionByRange("conv_id", "turn", "h").sortWithinPartitions("conv_id", "turn", "h")
    stretches = stored(dealt.mapInArrow(_stretches(stretch), _STRETCH.format(conv=kind)), "stretches")
    chained = stretches.drop("symbols").groupBy("conv_id").applyInArrow(_chained, _CHAINED.format(conv=kind))
    chained = stored(chained, "chained")
    same = F.col("s.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("s.task") == F.col("c.task")) & (F.col("s.nth") == F.col("c.nth"))
    met = stretches.alias("s").join(chained.alias("c"), same)
    traced = met.select("s.conv_id", "s.task", "s.nth", "symbols", "behind", "c.state").mapInArrow(
        _traced, _PART.format(conv=kind)
    )
    texts = rows.select("conv_id", F.lit(1).alias("kind"), F.lit(0).alias("task"), F.lit(0).alias("nth"), "turn", "h", "role", "text")
    parts = traced.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "task", "nth", "turn", "h")
    ends = parts.mapInArrow(_ends, f"conv_id {kind}, audit string, repaired_sha256 string")
    totals = chained.where("cost is not null").alias("c")
    both = totals.join(ends.alias("e"), F.col("c.conv_id").eqNullSafe(F.col("e.conv_id")))
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return both.select("c.conv_id", *sums, F.lit(None).cast("array<struct<role string, text string>>").alias("repaired"))


def turn_of(alias: str) -> Column:
    turn = F.col(f"{alias}.turn")
    return F.struct(turn.isNotNull().alias("there"), turn.alias("turn"))


def _stretches(size: int):
    """Sorted turns as stretches of one conversation each, with what they do to every vector and state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for batch in batches:
            starts = _cuts(batch["conv_id"])
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                copies = batch["copies"].slice(a, b - a).to_numpy()
                for low, high, taken in _shares(copies, size):
                    yield _stretch(batch.slice(a + low, high - low), taken, nth)
                    nth += 1

    return run


def _shares(copies: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Cut runs of equal turns into stretches of at most ``size`` turns: rows, and how many of each; later shares of a
    row are told by a negative number."""
    low, taken, total = 0, [], 0
    for i, n in enumerate(copies):
        begun = False
        while n:
            if total == size:
                yield low, low + len(taken), np.asarray(taken)
                low, taken, total = i, [], 0
            now = min(int(n), size - total)
            taken.append(-now if begun else now)
            total, n, begun = total + now, n - now, True
    if taken:
        yield low, low + len(taken), np.asarray(taken)


def _stretch(rows: pa.RecordBatch, taken: np.ndarray, nth: int) -> pa.RecordBatch:
    own = rows["symbol"].to_numpy().astype(np.int64)
    again = rows["later"].to_numpy(zero_copy_only=False) | (taken < 0)
    count = np.abs(taken)
    lead = np.where(again, GONE, own)
    symbols = np.full(int(count.sum()), GONE, np.int64)
    symbols[np.cumsum(count) - count] = lead
    blank = own == GONE
    initials = rows["initial"].to_numpy(zero_copy_only=False)
    # Inside a run of equal turns no neighbours are legal: they have one initial.
    illegal = int(_illegal(rows["initial"])[1:].sum() + (count - 1).sum())
    there = rows["turn"].drop_null().to_numpy()
    vector, cost, state = tables().effect(symbols)
    values = {
        "task": TaskContext.get().partitionId(), "nth": nth, "symbols": symbols.astype(np.int8).tobytes(),
        "vector": vector.tobytes(), "cost": cost.tobytes(), "state": state.tobytes(),
        "first_initial": initials[0], "last_initial": initials[-1], "illegal": illegal,
        "first_turn": int(there[0]) if len(there) else None, "last_turn": int(there[-1]) if len(there) else None,
        "turns": len(np.unique(there)), "blank": int(count[blank].sum()),
        "duplicate": int((count - ~again)[~blank].sum()), "truncated": int(((lead >= 4) & (lead < GONE)).sum()),
    }
    kinds = {"task": pa.int32(), "nth": pa.int32()} | {k: pa.binary() for k in ("symbols", "vector", "cost", "state")}
    kinds |= {"first_initial": pa.string(), "last_initial": pa.string()}
    columns = {k: pa.array([v], kinds.get(k, pa.int64())) for k, v in values.items()}
    return pa.RecordBatch.from_pydict({"conv_id": rows["conv_id"].slice(0, 1)} | columns)


def _chained(table: pa.Table) -> pa.Table:
    """The vector behind and the state before every stretch of a conversation; its sums stand with the first."""
    table = table.sort_by([("task", "ascending"), ("nth", "ascending")])
    own = tables()
    n, size = table.num_rows, len(own.vectors)
    effects = [
        (np.frombuffer(v, np.int32), np.frombuffer(c, np.int64), np.frombuffer(s, np.int32).reshape(size, _STATES))
        for v, c, s in zip(*(table[k].to_pylist() for k in ("vector", "cost", "state")), strict=True)
    ]
    behind, v, cost = [0] * n, 0, 0
    for i in reversed(range(n)):
        behind[i] = v
        cost += int(effects[i][1][v])
        v = int(effects[i][0][v])
    cost += int(own.vectors[v][0])
    states, q = [], 0
    for i in range(n):
        states.append(q)
        q = int(effects[i][2][behind[i], q])
    firsts, lasts = table["first_initial"].to_pylist(), table["last_initial"].to_pylist()
    seams = sum(1 for a, b in zip(lasts, firsts[1:], strict=False) if a + b not in ("su", "ua", "au"))
    low = [t for t in table["first_turn"].to_pylist() if t is not None]
    high = [t for t in table["last_turn"].to_pylist() if t is not None]
    turns = sum(table["turns"].to_pylist()) - sum(1 for a, b in zip(high, low[1:], strict=False) if a == b)
    sums = {k: sum(table[k].to_pylist()) for k in ("blank", "duplicate", "truncated", "illegal")}
    sums |= {"gaps": high[-1] - low[0] + 1 - turns if low else 0, "cost": cost}
    sums["illegal"] += seams
    once = lambda x: pa.array([x] + [None] * (n - 1), pa.int64())
    columns = {"conv_id": table["conv_id"], "task": table["task"], "nth": table["nth"]}
    columns |= {"behind": pa.array(behind, pa.int32()), "state": pa.array(states, pa.int32())}
    return pa.table(columns | {k: once(sums[k]) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")})


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of every stretch; inserts behind the last turn of a conversation are added when all are together."""
    for batch in batches:
        for i in range(batch.num_rows):
            symbols = np.frombuffer(batch["symbols"][i].as_py(), np.int8).astype(np.int64)
            _, edits, _ = tables().solve(symbols, np.zeros(1, np.int64), batch["behind"][i].as_py(), batch["state"][i].as_py())
            row = {"conv_id": batch["conv_id"].slice(i, 1), "kind": pa.array([0], pa.int32())}
            row |= {"task": batch["task"].slice(i, 1), "nth": batch["nth"].slice(i, 1), "turn": pa.nulls(1, pa.int64())}
            audit = "".join([tables().edits[e] for e in edits])
            row |= {"h": pa.nulls(1, pa.string()), "role": pa.nulls(1, pa.string()), "text": pa.array([audit], pa.string())}
            yield pa.RecordBatch.from_pydict(row)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole audits and digests, from the audits of the stretches followed by the turns themselves."""
    begun, key, audits, own, digest, first = False, None, [], None, None, True

    def told(turns) -> None:
        nonlocal first
        for role, text in turns:
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False

    def closed() -> pa.RecordBatch:
        own.audit += _ENDS[own.state]
        told(own.end())
        return pa.RecordBatch.from_pydict({"conv_id": key, "audit": pa.array([own.audit]), "repaired_sha256": pa.array([digest.hexdigest()])})

    for batch in batches:
        for low, high in zip(c := _cuts(batch["conv_id"]), np.append(c[1:], batch.num_rows), strict=True):
            here = batch["conv_id"].slice(low, 1)
            if not begun or not here.equals(key):
                if begun:
                    yield closed()
                begun, key, audits, own, digest, first = True, here, [], None, hashlib.sha256(), True
            rows = batch.slice(low, high - low)
            for kind, role, text in zip(*(rows[k].to_pylist() for k in ("kind", "role", "text")), strict=True):
                if kind == 0:
                    audits.append(text)
                    continue
                own = own or _Repaired("".join(audits))
                told(own.turn(role, text))
    if begun:
        yield closed()
