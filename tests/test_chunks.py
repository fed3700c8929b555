"""Long texts in chunks against the same texts as single rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import cloakwork as cw
from cloakwork.sources.chunks import cuts_of, joined

from . import samples as s

KEY = bytes(range(32))
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def odd_texts(n):
    """Key blocks of all lengths, open ones, ends without a beginning, findings everywhere, long and empty lines."""
    draw = random.Random(21)
    for _ in range(n):
        lines = []
        for _ in range(draw.randint(0, 40)):
            lines.append(
                draw.choice(
                    ["", "plain words", "é 漢字 🙂", "password = hunter2hunter2", s.OPENAI, f"x {BEGIN} y", f"{END} z", BEGIN, END, "MII" * 30]
                    + ["a" * draw.randint(1, 300), f"{BEGIN} one line {END}", "api_key: abcdefgh12345678 " + s.OPENAI]
                )
            )
        yield "\n".join(lines) + draw.choice(["", "\n", "\n\n"])


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for i, text in enumerate([*odd_texts(60), "", "\n", "no end", (s.THREE + "\n").replace("\n", "\r\n") * 30]):
        folder = root / f"d{i % 3}"
        folder.mkdir(exist_ok=True)
        (folder / f"f{i}.txt").write_bytes(text.encode())
    (root / "d0" / "f.png").write_text(s.OPENAI * 100)
    return str(root)


def rows(df, columns=None):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


@pytest.mark.parametrize("size", [37, 200, 1000])
def test_files_in_chunks(spark, tree, size):
    whole, chunks = cw.load_corpus(spark, tree), cw.load_chunks(spark, tree, chunk_bytes=size)
    chunks = spark.createDataFrame(chunks.collect(), chunks.schema)
    assert rows(joined(chunks, "text"), ["path", "text"]) == rows(whole, ["path", "text"])
    assert chunks.count() > whole.count() * (3 if size < 1000 else 1)
    want, got = cw.findings(whole, id_cols=["root", "path"]), cw.chunk_findings(chunks, id_cols=["root", "path"])
    assert want.columns == got.columns and rows(want) == rows(got)
    assert want.where("category = 'private_key' and length(value) > 100").count() > 10
    for mode in ("category", "number"):
        masked = joined(cw.protect_chunks(chunks, mode=mode, id_cols=["root", "path"]), "masked_text")
        assert rows(masked, ["path", "text"]) == rows(cw.mask(whole, mode=mode, id_cols=["root", "path"]), ["path", "masked_text"])


def test_masked_chunks_are_restored(spark, tree):
    chunks = cw.load_chunks(spark, tree, chunk_bytes=200)
    done = cw.protect_chunks(chunks, mode="number", key=KEY)
    ids = ["path", "chunk"]
    back = cw.unmask_numbered(done, cw.vault_of(done, ids), KEY, id_cols=ids)
    assert back.where("restored_text <> replace(text, '\r\n', '\n') and restored_text <> text").count() == 0


@pytest.mark.parametrize("size", [20, 333])
def test_texts_in_chunks(spark, texts, size):
    docs = texts(*odd_texts(80), None, "", s.THREE)
    chunks = cw.split_long(docs, chunk_chars=size)
    assert rows(joined(chunks.where("text is not null"), "text", ["doc_id"])) == rows(docs.where("text is not null"))
    assert rows(cw.findings(docs)) == rows(cw.chunk_findings(chunks.withColumn("path", F.lit(None).cast("string")), id_cols=["doc_id"]).select(cw.findings(docs).columns))
    assert chunks.where("text is null").count() == 1


def test_cuts():
    text = "ab\ncd\n" * 10
    cuts = cuts_of(text, 4)
    assert cuts[0] == 0 and all(text[c - 1] == "\n" for c in cuts[1:]) and len(cuts) == 10
    assert cuts_of("", 4) == [0] and cuts_of("no line end at all", 4) == [0] and cuts_of("abcdef\n", 4) == [0]


def test_what_cannot_be_cut(spark, texts, tmp_path):
    rule = cw.custom_rule("block", "(?s)FROM.*?TO")
    with pytest.raises(ValueError, match="span lines"):
        cw.chunk_findings(cw.split_long(texts("x")), id_cols=["doc_id"], custom=[rule])
    with pytest.raises(ValueError, match="there already"):
        cw.split_long(texts("x").withColumn("chunk", F.lit(1)))
    assert cw.load_chunks(spark, str(tmp_path / "none")).count() == 0
    assert cw.split_long(texts("x").limit(0)).count() == 0


def test_five_million_lines(spark, tmp_path):
    """One file of five million lines with a key every half million."""
    line = "const x = 1;\n"
    with open(tmp_path / "big.js", "w") as file:
        for _ in range(10):
            file.write(line * 499_999 + f"OPENAI_API_KEY={s.OPENAI}\n")
    chunks = cw.load_chunks(spark, str(tmp_path))
    assert chunks.count() == 8 and chunks.rdd.getNumPartitions() >= 4
    found = cw.chunk_findings(chunks).orderBy("line").collect()
    assert [(f.ordinal, f.line) for f in found] == [(i, i * 500_000) for i in range(1, 11)]
