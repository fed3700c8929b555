"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import conversations, queries

PATTERN = re.compile(r"(?:s?(?:ua)+)?\Z")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """The first fault of every (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        shown = BLANK.findall(text)
        if not shown:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least cost, first audit and repaired turns by a search in the order of (cost, audit); what came out so far is
    kept as its initials only."""
    found = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if i == len(rows) and PATTERN.match(initials):
            return cost, audit, list(out)
        state = i, "" if not initials else initials[-1] + ("s" if initials == "s" else "")
        if state in done or not re.match(r"s?(?:ua)*u?\Z", initials):
            continue
        done.add(state)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, initials + role[0], (*out, (role, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, initials, out))
            if found[i] not in ("blank", "duplicate"):
                more = 5 if found[i] == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials + role[0], (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, initials + new[0], (*out, (new, text))))


def brute(rows):
    """The whole answer for (turn, role, text) rows of one conversation."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, md5(md5(r[1]) + r[2])))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [r[1] for r in rows]
    cost, audit, out = cheapest([r[1:] for r in rows])
    found = faults([r[1:] for r in rows])
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(found.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(1 for a, b in zip(pairs, pairs[1:], strict=False) if a[:1] + b[:1] not in ("su", "ua", "au")),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def random_conversations(draw, n, most):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "update"]
    texts = ["one.", "two!", "three", "four?", "  ", "", None, "fi ve. \n", "six  ", "...", "x\n"]
    for c in range(n):
        size = draw.randint(1, most)
        for _ in range(size):
            turn = draw.choice([None, *range(size + 2)])
            text = draw.choice(texts)
            text = text if text is None or draw.random() < 0.5 else text + str(draw.randint(0, 99)) + draw.choice([".", "", "!"])
            yield (None if c == 0 else c), turn, draw.choice(roles), text


def grouped(rows):
    out: dict = {}
    for key, *rest in rows:
        out.setdefault(key, []).append(tuple(rest))
    return out


@pytest.mark.parametrize("long_rows", [10_000, 3])
def test_random_conversations(spark, long_rows):
    rows = list(random_conversations(random.Random(7), 400 if long_rows > 3 else 60, 9))
    table = spark.createDataFrame([(*r, 1, "h") for r in rows], "conv_id long, turn long, role string, text string, symbol int, h string")
    got = conversations.repair(table.repartition(5), long_rows=long_rows, stretch=2).collect()
    want = {k: brute(v) for k, v in grouped(rows).items()}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[f] for f in FIELDS) == want[r.conv_id], r.conv_id
        if r.repaired is not None:
            assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in r.repaired).encode()).hexdigest() == r.repaired_sha256


def test_query_by_brute_force(spark, small):
    rows = [tuple(r.values()) for r in pq.read_table(f"{small}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    harmed = []
    for conv, turn, role, text in rows:
        harm = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        harmed += [(conv, turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    by = {k: brute(v) for k, v in grouped(harmed).items()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = queries.op12_conversation_repair(spark, small).collect()
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in got} == {r[0]: by.get(r[0], nothing) for r in rows}
    assert len(got) == len({r[0] for r in rows})


def test_odd_and_empty_tables(spark, tmp_path):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(None, None, None, None), (1, None, "user", "a."), (1, None, "user", "a."), (2, 5, "user", "x" * 200_000), (3, 1, "s", "z.")]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/odd/conversations.parquet")
    got = {r.conv_id: r for r in queries.op12_conversation_repair(spark, f"{tmp_path}/odd").collect()}
    assert set(got) == {None, 1, 2, 3}
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op12_conversation_repair(spark, f"{tmp_path}/none").count() == 0


def test_one_long_conversation(spark):
    """Most rows in one conversation, half of them the same turn over and over."""
    long = spark.range(30_000).select(
        F.lit(1).alias("conv_id"),
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("turn"),
        F.when(F.col("id") % 4 < 2, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") % 2 == 0, "the same.").otherwise(F.concat(F.lit("turn "), "id", F.when(F.col("id") % 7 > 0, ".").otherwise(""))).alias("text"),
    )
    short = long.where("turn % 100 = 1").select(F.col("turn").alias("conv_id"), "turn", "role", "text")
    rows = long.select("conv_id", "turn", "role", "text").unionByName(short.where("conv_id > 1"))
    one = conversations.repair(rows, with_turns=False)
    other = conversations.repair(rows, with_turns=False, long_rows=1 << 20)
    key = lambda df: {r.conv_id: tuple(r[f] for f in FIELDS) for r in df.collect()}
    assert key(one) == key(other)
    assert key(one)[1][2] == 15_000 - 2


def test_blocks_and_single_steps_agree():
    draw = np.random.default_rng(3)
    sizes = draw.integers(1, 40, 200)
    starts = np.cumsum(sizes) - sizes
    symbols = draw.integers(0, 9, sizes.sum())
    one, four = conversations.Tables(1), conversations.Tables(4)
    for a, b in zip(one.solve(symbols, starts), four.solve(symbols, starts), strict=True):
        assert (a == b).all()
    v, cost, q = four.effect(symbols[:50])
    for vector in range(len(four.vectors)):
        for state in range(4):
            own, _, end = four.solve(symbols[:50], np.zeros(1, np.int64), vector, state)
            assert own[0] == cost[vector] + four.vectors[v[vector], state] and end[0] == q[vector, state]
