from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import cloakwork as cw
from cloakwork.functions.crypto import seal, unseal
from cloakwork.functions.tokens import is_vault_token, token_id
from cloakwork.operators.catalogue import INLINE_PREFIX

from . import samples as s

KEY = bytes(range(32))
OTHER = bytes(range(1, 33))


def masked(df, column="masked_text"):
    return {r.doc_id: r[column] for r in df.collect()}


def test_category_mask(texts):
    mixed = f"{s.OPENAI}\nconst token = '{s.GITHUB}';\n{s.MONGO}"
    out = masked(cw.mask(texts("password = 'abc123'", mixed, s.CLEAN_EXPORT, s.CLEAN, "", None, " \t\n")))
    assert out[0] == "password = '[REDACTED_password]'"
    assert out[1] == "OPENAI_API_KEY=[REDACTED_openai]\nconst token = '[REDACTED_github]';\n[REDACTED_database]"
    assert (out[2], out[3], out[4], out[5], out[6]) == (s.CLEAN_EXPORT, s.CLEAN, "", None, " \t\n")


def test_large_document(texts):
    out = masked(cw.mask(texts("const x = 1;\n" * 20000 + s.OPENAI)))
    assert out[0] == "const x = 1;\n" * 20000 + "OPENAI_API_KEY=[REDACTED_openai]"


def test_line_breaks(texts):
    out = masked(cw.mask(texts(s.THREE.replace("\n", "\r\n") + "\r\n\r\n", "a\r\nb\nc", f"a\r\nb\n{s.OPENAI}")))
    assert out[0].count("\r\n") == 4 and out[0].endswith("\r\n\r\n")
    assert out[1] == "a\r\nb\nc"
    # A mixed text with findings takes the CR LF throughout.
    assert out[2] == "a\r\nb\r\nOPENAI_API_KEY=[REDACTED_openai]"


def test_repeats_within_the_line(texts):
    docs = texts("password=abc123 abc123x\nabc123", "password=REDACTED a REDACTED", r"password=a\E.+$1 then a\E.+$1!")
    out = masked(cw.mask(docs))
    assert out[0] == "password=[REDACTED_password] [REDACTED_password]x\nabc123"
    assert out[1] == "password=[REDACTED_password] a [REDACTED_password]"
    assert out[2] == "password=[REDACTED_password] then [REDACTED_password]!"


def test_numbered_mask_and_vault(texts):
    done = cw.protect(texts(s.THREE, s.ONE_LINE, "password=abc123; password=abc123; pwd=zzzzzz"), mode="number", key=KEY)
    rows = {r.doc_id: r for r in done.collect()}
    assert rows[0].masked_text == "OPENAI_API_KEY=[REDACTED_1]\nDATABASE_PASSWORD=[REDACTED_2]\nAWS_SECRET_KEY=[REDACTED_3]"
    assert (rows[0].n_findings, rows[0].secret_lines, rows[1].n_findings, rows[1].secret_lines) == (3, 3, 2, 1)
    # The same value in one line shares the first token; numbers are not reused.
    assert rows[2].masked_text == "password=[REDACTED_1]; password=[REDACTED_1]; pwd=[REDACTED_3]"
    opened = cw.vault_of(done).withColumn("plain", unseal(F.col("payload"), KEY))
    plain = {(r.doc_id, r.token_id): r.plain for r in opened.collect()}
    assert plain[(0, "1")] == s.SECRET and plain[(1, "2")] == "root12345" and len(plain) == 8
    assert not cw.vault_of(done).where(F.col("payload").contains("root")).count()


def test_no_partial_leak(texts):
    for mode in ("category", "number", "inline", "vault"):
        out = masked(cw.mask(texts(s.OPENAI), mode=mode, key=KEY, corpus="c"))[0]
        assert s.SECRET not in out and s.SECRET[:8] not in out and s.SECRET[-8:] not in out


def test_restore_numbered(texts, spark):
    payload = seal(F.col("plain"), KEY, F.col("token_id"))
    vault = spark.createDataFrame(
        [(0, "9f3a", s.SECRET), (1, "9f3a", s.SECRET), (1, "2b71", "root12345"), (3, "9f3a", "x")],
        "doc_id long, token_id string, plain string",
    ).select("doc_id", "token_id", payload.alias("payload"))
    docs = texts(
        "OPENAI_API_KEY=[REDACTED_9f3a]",
        "KEY=[REDACTED_9f3a]\nPASS=[REDACTED_2b71]",
        "OPENAI_API_KEY=[REDACTED_ffff]",
        "just a normal line of code, nothing redacted here",
        "This is not [REDACTED_XYZ] a real token, just text.",
        None,
    ).withColumnRenamed("text", "masked_text")
    good = masked(cw.unmask_numbered(docs, vault, KEY), "restored_text")
    assert good[0] == f"OPENAI_API_KEY={s.SECRET}"
    assert good[1] == f"KEY={s.SECRET}\nPASS=root12345"
    for i in (2, 3, 4, 5):
        assert good[i] == masked(docs)[i]
    assert masked(cw.unmask_numbered(docs, vault, OTHER), "restored_text") == masked(docs)


@pytest.mark.parametrize("mode", ["number", "inline", "vault"])
def test_round_trips(texts, mode):
    block = f"a\r\nx {s.BLOCK} y password=abcdef"
    docs = texts(s.THREE, s.ONE_LINE, block, s.CLEAN, "é😀 password=p😀abcd 'p😀abcd'", None, "")
    done = cw.protect(docs, mode=mode, key=KEY, corpus="pepper").persist()
    if mode == "inline":
        back = cw.unmask_inline(done, KEY)
    else:
        restore = cw.unmask_numbered if mode == "number" else cw.unmask_vault
        back = restore(done, cw.vault_of(done), KEY)
    want = masked(docs, "text")
    want[2] = want[2].replace("\r\n", "\n").replace("\n", "\r\n") if mode != "inline" else want[2]
    got = masked(back, "restored_text")
    # Line breaks inside a key block belong to the secret and come back as they were.
    want[2] = "a\r\n" + block[3:]
    assert got == want
    counts = {r.doc_id: (r.tokens_seen, r.tokens_restored) for r in back.collect()}
    assert counts[0] == (3, 3) and counts[3] == (0, 0)
    done.unpersist()


def test_inline_tokens(texts):
    docs = cw.mask(texts(s.OPENAI, s.BLOCK), mode="inline", key=KEY).select("doc_id", "masked_text")
    out = masked(docs)
    # One token, on one line however long the secret.
    assert re.fullmatch(rf"OPENAI_API_KEY={INLINE_PREFIX}[A-Za-z0-9+/=]+", out[0])
    assert re.fullmatch(rf"{INLINE_PREFIX}[A-Za-z0-9+/=]+", out[1])
    wrong = cw.unmask_inline(docs, OTHER)
    assert masked(wrong, "restored_text") == out
    assert {(r.tokens_seen, r.tokens_restored) for r in wrong.collect()} == {(1, 0)}


def test_inline_second_part(texts):
    whole = masked(cw.mask(texts(s.OPENAI), mode="inline", key=KEY))[0]
    cut = texts(whole[:70] + ":" + whole[70:], whole + ":tail", whole + " tail").withColumnRenamed("text", "masked_text")
    back = masked(cw.unmask_inline(cut, KEY), "restored_text")
    assert back == {0: s.OPENAI, 1: s.OPENAI + ":tail", 2: s.OPENAI + " tail"}


def test_masking_is_stable_and_idempotent(texts):
    docs = texts(s.THREE, s.ONE_LINE, f"token = '{s.GITHUB}'", s.CONFIG_OBJECT)
    for mode in ("category", "number", "inline", "vault"):
        once = cw.mask(docs, mode=mode, key=KEY, corpus="c").select("doc_id", F.col("masked_text").alias("text"))
        assert masked(once, "text") == masked(once, "text")
        assert masked(cw.mask(once, mode=mode, key=KEY, corpus="c")) == masked(once, "text")


def test_no_value_is_left_in_its_line(spark):
    rng = random.Random(3)
    pieces = [s.OPENAI, f"token = '{s.GITHUB}'", "password=abc123", "abc123", "pwd: hunter22", "hunter22x", " ", "; ", "\n", s.MONGO]
    docs = spark.createDataFrame(
        [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for i in range(300)], "doc_id long, text string"
    ).repartition(4)
    values = {}
    for r in cw.findings(docs).collect():
        values.setdefault(r.doc_id, []).append((r.line, r.value))
    for doc_id, text in masked(cw.mask(docs)).items():
        lines = text.split("\n")
        for line, value in values.get(doc_id, []):
            assert value not in lines[line - 1]


def test_redact(texts):
    rows = {r.doc_id: r for r in cw.redact(texts(s.THREE, s.CLEAN)).collect()}
    assert rows[0].replacements == 3 and "root12345" not in rows[0].redacted_text
    assert (rows[1].replacements, rows[1].redacted_text) == (0, s.CLEAN)


def test_backup(texts):
    docs = texts(s.OPENAI, s.CLEAN)
    kept = cw.backup(docs)
    assert [r.doc_id for r in kept.collect()] == [0]
    back = {r.doc_id: r.original_text for r in cw.restore(texts("", "", "").select("doc_id"), kept).collect()}
    assert back == {0: s.OPENAI, 1: None, 2: None}
    everything = cw.backup(docs, only_masked=False)
    assert [r.doc_id for r in cw.forget(everything, docs.where("doc_id = 0")).collect()] == [1]


def test_wire_format_of_sealed_text(spark):
    """Ciphertext of iv | tag | body, made by an independent AES-GCM implementation (zero key, zero IV)."""
    # Known vector: 256-bit zero key, 96-bit zero IV, 16 zero bytes.
    body, tag = "cea7403d4d606b6e074ec5d3baf39d18", "d0d1c8a799996bf0265b98b5d48ab919"
    wire = spark.sql(f"SELECT base64(unhex('{'00' * 12}{tag}{body}')) AS p, unhex('{'00' * 16}') AS plain")
    row = wire.select(unseal(F.col("p"), bytes(32)).cast("binary").alias("got"), "plain").first()
    assert bytes(row.got) == bytes(row.plain)


def test_vault_tokens(spark):
    good = "CLOAKWORK_TOKEN_8f4c9e2d-a1b2-43d4-a5f6-7890abcdef12"
    rows = spark.createDataFrame([(good,), (good.replace("-43", "-33"),), ("CLOAKWORK_TOKEN_",), ("x",)], "t string")
    got = rows.select(is_vault_token(F.col("t")), token_id(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [
        (True, good[16:]), (False, good[16:].replace("-43", "-33")), (False, None), (False, None),
    ]
    with pytest.raises(Exception, match="not a vault token"):
        rows.select(token_id(F.col("t"), strict=True)).collect()


def test_bad_options(texts):
    with pytest.raises(ValueError):
        cw.mask(texts(""), mode="blur")
    with pytest.raises(ValueError):
        cw.mask(texts(""), mode="inline")
    with pytest.raises(ValueError):
        cw.mask(texts(""), mode="inline", key=b"short")
