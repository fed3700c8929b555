"""Token files against the tokenizers library, and the index against the keys."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloakwork.llm import queries, token_files
from cloakwork.session import scratch_dir


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.vocabulary())


def expected(library, rows):
    """Rows in the order of the files, by the library on whole texts."""
    at = 0
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        yield key, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), ids
        at += len(ids)


def test_query_by_brute_force(spark, small, library):
    docs = pq.read_table(f"{small}/documents.parquet").to_pylist()
    want = [w[:4] for w in expected(library, sorted((d["doc_id"], d["text"]) for d in docs))]
    got = queries.op11_token_files(spark, small).orderBy("row").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    assert [r.row for r in got] == list(range(len(want)))


def test_odd_rows(spark, library, tmp_path):
    long = "wörd " * 3000 + "x" * 5000
    texts = [
        (None, "no id"), (-5, None), (-5, None), (2, ""), (2, "zwei"), (2, "zwei"), (9, long), (11, "<|endoftext|> \n\n a\tb c é é ́x İ"),
        (2**40, " \n "),
    ]
    docs = spark.createDataFrame([(i, t, 1, "r", b"") for i, t in texts], "doc_id long, text string, key int, row string, ids binary")
    path = scratch_dir(spark, "test-store")
    token_files.write(docs, path, queries.vocabulary())
    got = token_files.read(docs, path).orderBy("row").collect()
    order = sorted(texts, key=lambda r: -(2**63) if r[0] is None else r[0])
    assert [r.key for r in got] == [-(2**63) if i is None else i for i, _ in order]
    at = 0
    by_key: dict = {}
    for r in got:
        assert r.start == at
        at += r.n_tokens
        by_key.setdefault(None if r.key == -(2**63) else r.key, []).append(np.frombuffer(r.ids, "<u4").tolist())
    coded: dict = {}
    for key, _, _, _, ids in expected(library, order):
        coded.setdefault(key, []).append(ids)
    assert {k: sorted(v) for k, v in by_key.items()} == {k: sorted(v) for k, v in coded.items()}
    single = token_files.get(path, [2, 9, None, 77])
    assert sorted(x.tolist() for x in single[2]) == sorted(coded[2])
    assert [x.tolist() for x in single[9]] == coded[9] and [x.tolist() for x in single[None]] == coded[None]
    assert single[77] == []
    absent = spark.range(1000, 3000).withColumnRenamed("id", "doc_id")
    assert token_files.read(absent, path).count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = scratch_dir(spark, "test-store")
    token_files.write(docs, path, queries.vocabulary())
    assert token_files.read(docs, path).count() == 0
    assert token_files.get(path, [1]) == {1: []}


def test_one_key_over_many_shards(spark, library):
    """A key with most rows is cut over shards, equal rows too, and comes back whole."""
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.lit("the same")).otherwise(F.concat(F.lit("text "), "id")).alias("text"),
    )
    path = scratch_dir(spark, "test-store")
    token_files.write(docs, path, queries.vocabulary(), parts=16)
    assert spark.read.parquet(f"{path}/shards").where("rows > 600").count() == 0
    got = token_files.read(docs, path)
    assert got.count() == 3000 and got.where("key = -1").count() == 2000
    ids = library.encode("the same", add_special_tokens=False).ids + [2]
    assert got.where(F.col("ids") == np.asarray(ids, "<u4").tobytes()).count() == 1500
    row = got.agg(F.count_distinct("row").alias("n"), F.max("row").alias("top")).first()
    assert (row.n, row.top) == (3000, 2999)
    assert sum(len(v) for v in token_files.get(path, [-1]).values()) == 2000


def test_perfect_hash():
    draw = np.random.default_rng(5)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(np.concatenate([draw.integers(-(2**62), 2**62, n // 2), np.arange(n - n // 2)]))
        own, end = token_files.PerfectHash.read(token_files.PerfectHash.of(keys).write() + b"rest")
        assert sorted(own.numbers(keys)) == list(range(len(keys)))
        assert own.numbers(np.arange(-100, 0)).max(initial=-1) < max(1, len(keys))


def test_long_texts_in_pieces(library):
    own = token_files.Encoder(queries.vocabulary())
    for text in ("ab cd " * 500, "x" * 3000, "  a" * 700, ""):
        pieces = list(token_files._pieces(text, 100))
        assert "".join(pieces) == text
        ids = [i for p in pieces for i in own.encode(pa.array([p]))[1].tolist()]
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_words_are_forgotten_without_harm(library, monkeypatch):
    monkeypatch.setattr(token_files, "MAX_WORDS", 3)
    own = token_files.Encoder(queries.vocabulary())
    for text in ("one two three four five", "one six", "two seven one"):
        assert own.encode(pa.array([text]))[1].tolist() == library.encode(text, add_special_tokens=False).ids
