"""Rules that look at line ends or across lines, values that only begin like a token, and shared vaults."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import cloakwork as cw
from cloakwork.functions.tokens import is_vault_token
from cloakwork.plans.queries import KEY


def values(df):
    return sorted(r.value for r in df.collect())


@pytest.mark.parametrize("pattern", ["^KEY_[0-9]{6}$", r"(?<=^)KEY_[0-9]{6}(?=$)", r"\AKEY_[0-9]{6}\z", "(?m)^KEY_[0-9]{6}$"])
def test_anchored_rules(texts, pattern):
    rule = cw.custom_rule("anchored", pattern)
    docs = texts("a\nKEY_123456\nb", "KEY_123456", "x KEY_123456", "KEY_123456\n")
    for scope in ("document", "line"):
        found = cw.findings(docs, custom=[rule], scope=scope, id_cols=["doc_id"])
        assert sorted(r.doc_id for r in found.collect()) == [0, 1, 3]
        masked = cw.mask(docs, custom=[rule], scope=scope).orderBy("doc_id").collect()
        assert "KEY_" not in masked[0].masked_text and masked[2].n_findings == 0


@pytest.mark.parametrize("pattern", ["(?is)begin.*?end", "(?s)BEGIN.*?END", "BEGIN[^Z]*END", r"BEGIN [\w\W]*?END"])
def test_multiline_rules(texts, pattern):
    found = cw.findings(texts("x BEGIN ab\ncd END y"), custom=[cw.custom_rule("block", pattern)], id_cols=["doc_id"])
    assert values(found) == ["BEGIN ab\ncd END"]


def test_a_value_that_begins_like_a_token(texts):
    docs = texts("password=[REDACTED_x]hunter2hunter2", "password=[REDACTED_x]", "password=[REDACTED_openai-key]")
    found = cw.mask(docs).orderBy("doc_id").collect()
    assert [r.n_findings for r in found] == [1, 0, 0] and "hunter2" not in found[0].masked_text


def test_two_corpora_in_one_vault(texts):
    one, two = texts("password=firstSecret99"), texts("password=otherSecret77")
    done = [cw.protect(d, mode="vault", key=KEY, corpus=c).withColumn("c", F.lit(c)) for d, c in ((one, "a"), (two, "b"))]
    both = done[0].unionByName(done[1])
    restored = cw.unmask_vault(both.drop("vault"), cw.vault_of(both), KEY, id_cols=["c", "doc_id"]).orderBy("c").collect()
    assert [r.restored_text for r in restored] == ["password=firstSecret99", "password=otherSecret77"]
    with pytest.raises(ValueError):
        cw.protect(one, mode="vault", key=KEY)


def test_one_id_with_two_payloads_restores_nothing(texts, spark):
    done = cw.protect(texts("password=firstSecret99"), mode="number", key=KEY)
    vault = cw.vault_of(done)
    other = cw.vault_of(cw.protect(texts("password=otherSecret77"), mode="number", key=KEY))
    row = cw.unmask_numbered(done.drop("vault"), vault.unionByName(vault).unionByName(other), KEY).first()
    assert row.restored_text == row.masked_text
    assert cw.unmask_numbered(done.drop("vault"), vault.unionByName(vault), KEY).first().restored_text == "password=firstSecret99"


def test_a_token_ends_where_the_text_does(spark):
    token = cw.protect(spark.createDataFrame([(1, "password=firstSecret99")], "doc_id long, text string"), mode="vault", key=KEY, corpus="c")
    text = token.select(F.regexp_replace("masked_text", "^password=", "").alias("t"))
    assert text.select(is_vault_token(F.col("t"))).first()[0]
    assert not text.select(is_vault_token(F.concat("t", F.lit("\n")))).first()[0]
