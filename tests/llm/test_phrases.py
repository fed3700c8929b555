"""Collocations against a count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cloakwork.llm import phrases, queries
from cloakwork.llm.common import LOWER, UPPER


def grams(text, most=4):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UPPER, LOWER))):
        words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
        for size in range(1, most + 1):
            for i in range(len(words) - size + 1):
                yield tuple(words[i : i + size])


def brute(rows, least=30, top=2000):
    counts = defaultdict(Counter)
    for lang, text in rows:
        counts["und" if lang is None else lang].update(grams(text))
    out = []
    for lang, f in counts.items():
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = defaultdict(int)
        for p, c in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], c)
        kept = []
        for p, a in found.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(c for p, c in f.items() if len(p) == 1)
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def random_texts(draw):
    """Languages of many kinds: few words or many, fixed phrases, repeated texts, hardly any text at all."""
    for lang in [None, "und", *(f"l{i}" for i in range(30))]:
        words = [f"W{chr(0xE0 + i % 20)}{i}" for i in range(draw.choice([2, 5, 20, 60]))]
        fixed = [draw.choices(words, k=draw.randint(2, 6)) for _ in range(draw.choice([0, 3, 20]))]
        for _ in range(draw.choice([1, 5, 40])):
            text = []
            for _ in range(draw.randint(0, 60)):
                text += draw.choice(fixed) if fixed and draw.random() < 0.4 else [draw.choice(words)]
                text[-1] += draw.choice(["", "", "", " \t", ",", " ; ", "\n"])
            yield lang, " ".join(text)
    yield "l0", None
    yield "l1", ""
    yield "empty", " ... \n"


@pytest.mark.parametrize(("least", "top", "first"), [(2, 5, 1), (3, 2000, 4)])
def test_random_languages(spark, monkeypatch, least, top, first):
    """Also where limits have to go down, several times for some languages."""
    monkeypatch.setattr(phrases, "FIRST", first)
    rows = list(random_texts(random.Random(11)))
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "lang string, text string, phrase string, c int").repartition(3)
    assert rows_of(phrases.collocations(docs, least=least, top=top)) == brute(rows, least, top)


def test_query_by_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("lang", "text").collect()]
    assert rows_of(queries.op13_phrase_collocations(spark, small)) == brute(rows)


def test_tables_without_phrases(spark):
    kind = "lang string, text string"
    for rows in ([], [("en", None), (None, "")], [("en", "one two three")]):
        assert phrases.collocations(spark.createDataFrame(rows, kind)).count() == 0


def test_products_beyond_64_bits(spark):
    big = 10**13
    known = spark.createDataFrame([("x", "a", big), ("x", "b", big + 1), ("x", "a b", big - 1)], "lang string, phrase string, c long")
    row = phrases.scored(known.where("phrase = 'a b'"), known).first()
    assert row.score == 2_000_000 * (big - 1) // (2 * big + 1)


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_long_texts_in_parts(size):
    draw = random.Random(5)
    for _ in range(60):
        words = draw.choices(["a", "bb", "ccc", "x" * 30], k=200)
        text = "".join(w + draw.choice([" ", "  ", " \t ", "\t"] + ([",", " . "] if draw.random() < 0.3 else [])) for w in words)
        whole = Counter(p for p in grams(text) if len(p) == size)
        parts = list(phrases.cut(text, size, 40))
        assert Counter(p for part in parts for p in grams(part) if len(p) == size) == whole
        assert len(parts) > 3


def hashes(rows):
    return phrases.phrase_hashes(*(pa.array(c) for c in zip(*rows, strict=True)))


def test_filters_miss_nothing(spark):
    rows = [("en", f"word{i} of{i % 7}") for i in range(5000)] + [("fr", "seul")]
    own = phrases.filter_of(spark.createDataFrame(rows, "lang string, phrase string"))
    assert own.holds(hashes(rows)).all()
    assert own.holds(hashes([("de", p) for _, p in rows])).mean() < 0.05
    words = phrases.Words(pa.array(["en"]), pa.array(["seul word1 of1"]))
    found = words.phrases(2, {"words": phrases.Filter(np.full(8192, 255, np.uint8)), "whole": own})
    assert {k: v.to_pylist() for k, v in found.items()} == {"lang": ["en"], "phrase": ["word1 of1"], "c": [1]}
