"""Restoring, backups, sealed text and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.crypto import fingerprint, seal, unseal
from ...functions.tokens import UUID4, is_vault_token, token_id, vault_id, vault_token
from ...operators.backup import backup, forget, restore
from ...operators.backup_log import BackupLog
from ...operators.mask import mask, protect, vault_of
from ...operators.unmask import unmask_inline, unmask_numbered, unmask_vault
from ...session import scratch_dir, stored
from ..oracle import WRAPPED_DOCUMENTS, detect_sql, hash_sql, wrapped_sql
from ..planted import hash_of, wrapped
from .common import DOCUMENTS, KEY, OTHER_KEY, documents, order_keys, orders_text, query, table, wrapped_documents


@query(WRAPPED_DOCUMENTS)
def token_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = stored(protect(wrapped_documents(spark, sf_dir), mode="number", key=KEY).drop("text"), "numbered")
    restored = unmask_numbered(done.drop("vault"), vault_of(done), KEY)
    return restored.select("doc_id", F.col("restored_text").alias("text"))


@query(WRAPPED_DOCUMENTS)
def vault_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = stored(protect(wrapped_documents(spark, sf_dir), mode="vault", key=KEY, corpus="documents").drop("text"), "vault")
    restored = unmask_vault(done.drop("vault"), vault_of(done), KEY)
    return restored.select("doc_id", F.col("restored_text").alias("text"))


@query(
    detect_sql(WRAPPED_DOCUMENTS)
    + """SELECT s.doc_id, any_value(s.text) AS text, count(f.doc_id)::INTEGER AS tokens_seen,
  count(f.doc_id)::INTEGER AS tokens_restored
FROM src s LEFT JOIN found f ON s.doc_id = f.doc_id GROUP BY s.doc_id"""
)
def inline_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mask(wrapped_documents(spark, sf_dir), mode="inline", key=KEY).select("doc_id", "masked_text")
    return unmask_inline(done, KEY).select(
        "doc_id", F.col("restored_text").alias("text"), "tokens_seen", "tokens_restored"
    )


@query("SELECT doc_id, TRUE AS unchanged, 0::INTEGER AS tokens_restored FROM documents")
def wrong_key_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mask(wrapped_documents(spark, sf_dir), mode="inline", key=KEY).select("doc_id", "masked_text")
    return unmask_inline(done, OTHER_KEY).select(
        "doc_id", (F.col("restored_text") == F.col("masked_text")).alias("unchanged"), "tokens_restored"
    )


_ODD = "KEY=[REDACTED_ffff] a [REDACTED_private_key] b [REDACTED_XYZ]"


@query(f"SELECT o_orderkey AS doc_id, '{_ODD}' AS text, 2::INTEGER AS tokens_seen FROM orders")
def unknown_token_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens without a vault row stay; a category mask is no token at all."""
    texts = orders_text(spark, sf_dir, lambda key: F.lit(_ODD)).withColumnRenamed("text", "masked_text")
    key = F.col("doc_id")
    vault = texts.select(
        "doc_id",
        F.lit("9f3a").alias("token_id"),
        seal(F.md5(key.cast("string")), KEY, key.cast("string")).alias("payload"),
        F.lit("generic").alias("category"),
    )
    restored = unmask_numbered(texts, vault, KEY)
    return restored.select("doc_id", F.col("restored_text").alias("text"), "tokens_seen")


@query(
    """SELECT o_orderkey AS doc_id, 'KEY=' || md5(CAST(o_orderkey AS VARCHAR)) || chr(10) || 'PASS='
  || CASE WHEN o_orderkey % 2 = 0 THEN 'root' || o_orderkey ELSE '[REDACTED_2b71]' END AS text,
  2::INTEGER AS tokens_seen, (CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END)::INTEGER AS tokens_restored
FROM orders"""
)
def restore_from_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokens per text; every other second payload is sealed with another key and stays masked."""
    texts = orders_text(spark, sf_dir, lambda key: F.lit("KEY=[REDACTED_9f3a]\nPASS=[REDACTED_2b71]"))
    texts = texts.withColumnRenamed("text", "masked_text")
    key = F.col("doc_id")
    where = key.cast("string")
    root = F.concat(F.lit("root"), where)
    second = F.when(key % 2 == 0, seal(root, KEY, where)).otherwise(seal(root, OTHER_KEY, where))
    rows = F.array(
        F.struct(F.lit("9f3a").alias("token_id"), seal(F.md5(where), KEY, where).alias("payload")),
        F.struct(F.lit("2b71").alias("token_id"), second.alias("payload")),
    )
    vault = stored(texts.select("doc_id", F.inline(rows)), "payloads")
    return unmask_numbered(texts, vault, KEY).select(
        "doc_id", F.col("restored_text").alias("text"), "tokens_seen", "tokens_restored"
    )


@query(
    detect_sql(WRAPPED_DOCUMENTS)
    + "SELECT doc_id, CAST(ordinal AS VARCHAR) AS token_id, category, value FROM found"
)
def vault_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token map, opened again."""
    vault = vault_of(protect(wrapped_documents(spark, sf_dir), mode="number", key=KEY))
    return vault.select("doc_id", "token_id", "category", unseal(F.col("payload"), KEY).alias("value"))


@query(
    detect_sql(DOCUMENTS)
    + """SELECT s.doc_id, CASE WHEN s.doc_id IN (SELECT doc_id FROM found) THEN s.text END AS original_text FROM src s"""
)
def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only documents with findings are backed up; the others restore to null."""
    docs = documents(spark, sf_dir)
    return restore(docs.select("doc_id"), backup(docs))


@query("SELECT doc_id, text FROM documents WHERE doc_id % 2 = 1")
def backup_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    done = docs.where(F.col("doc_id") % 2 == 0).select("doc_id")
    return forget(backup(docs, only_masked=False), done)


@query(
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 1 THEN text WHEN doc_id % 6 = 0 THEN text || ' edited' END AS original_text
FROM documents"""
)
def backup_log_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put, clear, put again, compact, clear, restore."""
    docs = documents(spark, sf_dir)
    log = BackupLog(spark, scratch_dir(spark, "backup"), buckets=8)
    log.put(docs)
    log.clear(docs.where("doc_id % 2 = 0"))
    log.put(docs.where("doc_id % 6 = 0").select("doc_id", F.concat("text", F.lit(" edited")).alias("text")))
    log.compact()
    log.clear(docs.where("doc_id % 5 = 0"))
    return log.restore(docs.select("doc_id"))


@query(
    """SELECT o_orderkey AS doc_id, md5(CAST(o_orderkey AS VARCHAR)) AS plain, TRUE AS other_key_fails, TRUE AS garbage_fails,
  80::INTEGER AS payload_length, sha256(md5(CAST(o_orderkey AS VARCHAR))) AS fingerprint FROM orders"""
)
def sealed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 bytes IV, 16 bytes tag and 32 bytes of text make 80 characters of base64."""
    key = F.col("o_orderkey").cast("string")
    plain = order_keys(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), F.md5(key).alias("plain"))
    sealed = plain.select("doc_id", "plain", seal(F.col("plain"), KEY, F.col("doc_id").cast("string")).alias("payload"))
    payload = F.col("payload")
    return sealed.select(
        "doc_id",
        unseal(payload, KEY).alias("plain"),
        unseal(payload, OTHER_KEY).isNull().alias("other_key_fails"),
        unseal(F.reverse(payload), KEY).isNull().alias("garbage_fails"),
        F.length(payload).alias("payload_length"),
        fingerprint(F.col("plain")).alias("fingerprint"),
    )


_CANDIDATE = """CASE o_orderkey % 4 WHEN 0 THEN substr(h, 1, 8)||'-'||substr(h, 9, 4)||'-4'||substr(h, 14, 3)||'-a'||
  substr(h, 18, 3)||'-'||substr(h, 21, 12)
  WHEN 1 THEN upper(substr(h, 1, 8)||'-'||substr(h, 9, 4)||'-4'||substr(h, 14, 3)||'-9'||substr(h, 18, 3)||'-'||substr(h, 21, 12))
  WHEN 2 THEN substr(h, 1, 8)||'-'||substr(h, 9, 4)||'-1'||substr(h, 14, 3)||'-a'||substr(h, 18, 3)||'-'||substr(h, 21, 12)
  ELSE '' END"""


@query(
    f"""SELECT o_orderkey AS doc_id, nullif(id, '') AS token_id,
  regexp_matches('CLOAKWORK_TOKEN_' || id, '(?i)^CLOAKWORK_TOKEN_{UUID4}$') AS valid, TRUE AS own_valid
FROM (SELECT o_orderkey, {_CANDIDATE} AS id FROM (SELECT o_orderkey, {hash_sql("o_orderkey")} AS h FROM orders))"""
)
def vault_token_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    h = hash_of(key)

    def uuid(version: str, variant: str) -> Column:
        return F.concat(
            F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-" + version), F.substring(h, 14, 3),
            F.lit("-" + variant), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
        )

    given = (
        F.when(key % 4 == 0, uuid("4", "a"))
        .when(key % 4 == 1, F.upper(uuid("4", "9")))
        .when(key % 4 == 2, uuid("1", "a"))
        .otherwise(F.lit(""))
    )
    token = vault_token(given)
    own = vault_token(vault_id("salt", key.cast("string")))
    return order_keys(spark, sf_dir).select(
        key.alias("doc_id"),
        token_id(token).alias("token_id"),
        is_vault_token(token).alias("valid"),
        is_vault_token(own).alias("own_valid"),
    )


@query(
    "SELECT 'documents' AS corpus, doc_id AS id, " + wrapped_sql("text", "doc_id") + " AS text FROM documents UNION ALL "
    "SELECT 'pages', page_id, " + wrapped_sql("url", "(page_id + 7)") + " FROM pages"
)
def vault_two_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages with the same numbers share a vault, and each gets its own secrets back."""
    pages = table(spark, sf_dir, "pages")
    texts = {
        "documents": wrapped_documents(spark, sf_dir),
        "pages": pages.select(F.col("page_id").alias("doc_id"), wrapped(F.col("url"), F.col("page_id") + 7).alias("text")),
    }
    done = [
        protect(rows, mode="vault", key=KEY, corpus=name).drop("text").withColumn("corpus", F.lit(name))
        for name, rows in texts.items()
    ]
    both = stored(done[0].unionByName(done[1]), "vault")
    restored = unmask_vault(both.drop("vault"), vault_of(both), KEY, id_cols=["corpus", "doc_id"])
    return restored.select("corpus", F.col("doc_id").alias("id"), F.col("restored_text").alias("text"))
