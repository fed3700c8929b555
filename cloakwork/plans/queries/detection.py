"""Detection: on the documents as they are, with planted secrets, one category at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.text import decode_entities, shannon_bits
from ...operators.catalogue import BUILTIN_RULES, custom_rule, rule_set
from ...operators.detect import detect, findings
from ...operators.mask import mask, redact
from ...operators.rule_index import rule_index
from ...operators.score import classify
from ...sources.corpus import spread
from .. import report
from ..oracle import (
    WRAPPED_DOCUMENTS,
    detect_sql,
    entropy_sql,
    hash_sql,
    masked_sql,
    pick_sql,
    quote,
    value_sql,
)
from ..planted import BLOCKS, CUSTOM, CUSTOM_PATTERN, PLANTS, Plant, hash_of, note, value_of
from .common import (
    CONVERSATIONS,
    DOCUMENTS,
    documents,
    messages_text,
    order_keys,
    orders_text,
    query,
    table,
    wrapped_documents,
)


@query(detect_sql(DOCUMENTS) + "SELECT category, count(*) AS n_findings FROM found GROUP BY category")
def findings_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_category(findings(documents(spark, sf_dir)))


@query(
    detect_sql(DOCUMENTS)
    + """SELECT doc_id, ordinal, line, col, rule_id, category, value, sha256(value) AS fingerprint FROM found"""
)
def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(documents(spark, sf_dir)).select(
        "doc_id", "ordinal", "line", F.col("column").alias("col"), "rule_id", "category", "value", "fingerprint"
    )


@query(masked_sql(DOCUMENTS) + "SELECT * FROM masked")
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(documents(spark, sf_dir)).drop("text")


@query(detect_sql("SELECT item_id AS doc_id, text FROM benchmark") + """
SELECT s.doc_id, count(f.doc_id)::INTEGER AS n_findings FROM src s LEFT JOIN found f ON s.doc_id = f.doc_id
GROUP BY s.doc_id""")
def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    return detect(texts).select("doc_id", "n_findings")


_DECODED = """SELECT page_id AS doc_id, replace(replace(replace(replace(replace(
  html, '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text FROM pages"""


@query(detect_sql(_DECODED) + "SELECT doc_id, ordinal, line, col, category, value FROM found")
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select(
        F.col("page_id").alias("doc_id"), decode_entities(F.col("html")).alias("text")
    )
    return findings(pages).select("doc_id", "ordinal", "line", F.col("column").alias("col"), "category", "value")


@query(
    detect_sql(WRAPPED_DOCUMENTS)
    + """SELECT doc_id, ordinal, line, col, rule_id, category, value,
  round(entropy_score, 6) AS entropy_score, context_score, round(confidence, 6) AS confidence,
  round(risk, 2) AS risk,
  array_to_string(['regex'] || CASE WHEN entropy_score >= 0.6 THEN ['entropy'] ELSE [] END
    || CASE WHEN context_score > 0 THEN ['context'] ELSE [] END, ',') AS features
FROM found"""
)
def scored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(wrapped_documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "ordinal",
        "line",
        F.col("column").alias("col"),
        "rule_id",
        "category",
        "value",
        F.round("entropy_score", 6).alias("entropy_score"),
        "context_score",
        F.round("confidence", 6).alias("confidence"),
        "risk",
        F.array_join("features", ",").alias("features"),
    )


_PER_DOCUMENT = """, names AS (
  SELECT doc_id, category, count(*) AS n, max(risk) AS risk FROM found GROUP BY doc_id, category),
docs AS (
  SELECT doc_id, sum(n)::INTEGER AS n, max(risk) AS risk,
    string_agg(category || '=' || n, ', ' ORDER BY category) AS parts FROM names GROUP BY doc_id)
"""


@query(
    detect_sql(WRAPPED_DOCUMENTS)
    + _PER_DOCUMENT
    + """SELECT s.doc_id, coalesce(n, 0)::INTEGER AS n_findings, round(coalesce(risk, 0), 2) AS max_risk,
  CASE WHEN n IS NULL THEN '0 finding(s)' ELSE n || ' finding(s): ' || parts END AS summary
FROM src s LEFT JOIN docs d ON s.doc_id = d.doc_id"""
)
def detection_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(wrapped_documents(spark, sf_dir)).select("doc_id", "n_findings", "max_risk", "summary")


@query(detect_sql(WRAPPED_DOCUMENTS) + "SELECT doc_id, max(risk) AS max_risk FROM found GROUP BY doc_id")
def max_risk_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.max_risk(findings(wrapped_documents(spark, sf_dir)))


@query(
    detect_sql(WRAPPED_DOCUMENTS)
    + "SELECT sha256(value) AS fingerprint, category, count(*) AS n_findings FROM found GROUP BY ALL"
)
def finding_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.repeated_secrets(findings(wrapped_documents(spark, sf_dir)))


@query(
    detect_sql(WRAPPED_DOCUMENTS)
    + "SELECT doc_id, ordinal, category, value FROM found WHERE confidence >= 0.95"
)
def confident_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``min_confidence`` numbers what is left as it was found."""
    found = findings(wrapped_documents(spark, sf_dir), min_confidence=0.95)
    return found.select("doc_id", "ordinal", "category", "value")


@query(masked_sql(WRAPPED_DOCUMENTS) + "SELECT * FROM masked")
def masked_wrapped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(wrapped_documents(spark, sf_dir)).drop("text")


@query(masked_sql(WRAPPED_DOCUMENTS, "'[REDACTED_'||ordinal||']'") + "SELECT doc_id, masked_text FROM masked")
def token_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(wrapped_documents(spark, sf_dir), mode="number").select("doc_id", "masked_text")


@query(masked_sql(WRAPPED_DOCUMENTS) + "SELECT doc_id, masked_text AS redacted_text, n_findings AS replacements FROM masked")
def replacements_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(wrapped_documents(spark, sf_dir))


@query(masked_sql(WRAPPED_DOCUMENTS) + "SELECT doc_id, secret_lines FROM masked")
def secret_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(wrapped_documents(spark, sf_dir)).select("doc_id", "secret_lines")


@query(masked_sql(CONVERSATIONS) + "SELECT * FROM masked")
def masked_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(messages_text(spread(table(spark, sf_dir, "conversations")))).drop("text")


def _planted_sql(plant: Plant) -> str:
    return f"""SELECT o_orderkey AS doc_id, '{plant.category}' AS category,
  {value_sql(plant, "o_orderkey")} AS value, 2::INTEGER AS line, {len(plant.before) + 1}::INTEGER AS col FROM orders"""


def _register_planted(plant: Plant) -> None:
    def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = orders_text(spark, sf_dir, lambda key: note(plant, key))
        return findings(texts).select("doc_id", "category", "value", "line", F.col("column").alias("col"))

    planted.__name__ = f"planted_{plant.category}"
    query(_planted_sql(plant))(planted)


for _plant in PLANTS + BLOCKS:
    _register_planted(_plant)


_DOCUMENT_CUSTOM = custom_rule("internal_api_key", CUSTOM_PATTERN, "api_key")


@query(_planted_sql(CUSTOM).replace("AS category,", "AS category, 'internal_api_key' AS rule_id,"))
def custom_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = orders_text(spark, sf_dir, lambda key: note(CUSTOM, key))
    found = findings(texts, custom=[_DOCUMENT_CUSTOM])
    return found.select("doc_id", "category", "rule_id", "value", "line", F.col("column").alias("col"))


@query(
    """SELECT o_orderkey AS doc_id, 'org' || (o_orderkey % 250) AS rule_id,
  'ORG' || (o_orderkey % 250) || '_' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16) AS value FROM orders"""
)
def many_custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More rules than are compiled one by one."""
    rules = [custom_rule(f"org{i}", f"ORG{i}_[0-9a-f]{{16}}") for i in range(250)]

    def text(key: Column) -> Column:
        name = (key % 250).cast("string")
        return F.concat(F.lit("ref ORG"), name, F.lit("_"), F.substring(hash_of(key), 1, 16), F.lit("."))

    found = findings(orders_text(spark, sf_dir, text), custom=rules)
    return found.select("doc_id", "rule_id", "value")


def word_rules(docs: DataFrame) -> DataFrame:
    """A rule for every longer word that stands at the end of a sentence or clause; the table grows with the texts."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(_CLAUSE_END), F.lit(1))).alias("name")).distinct()
    pattern = F.concat(F.lit(" "), F.col("name"), F.lit("[.,]"))
    return words.select(F.col("name").alias("item"), "name", pattern.alias("pattern"), F.lit("custom").alias("category"))


_CLAUSE_END = " ([A-Za-z]{8,})[.,]"


@query(
    f"""SELECT doc_id, rule_id, count(*) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_CLAUSE_END}', 1)) AS rule_id FROM documents) GROUP BY ALL"""
)
def rule_table_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of rules in a table, found by an index of their literals."""
    docs = documents(spark, sf_dir)
    found = findings(docs, rules=rule_index(word_rules(docs)))
    return found.where("category = 'custom'").groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT o_orderkey AS doc_id, 'custom' AS category,
  CASE WHEN o_orderkey % 2 = 0 THEN '/page/p' || o_orderkey ELSE '/page/=' || o_orderkey END AS value,
  CASE WHEN o_orderkey % 2 = 0 THEN 0.2 ELSE
    round(0.5 + 0.1 * least(1.0, {entropy_sql("('/page/=' || o_orderkey)")} / 5), 6) END AS confidence
FROM orders"""
)
def path_like_custom_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text(key: Column) -> Column:
        tail = F.when(key % 2 == 0, F.lit("p")).otherwise(F.lit("="))
        return F.concat(F.lit("see /page/"), tail, key.cast("string"))

    found = findings(orders_text(spark, sf_dir, text), custom=[custom_rule("page", "/page/[p=][0-9]+")])
    return found.select("doc_id", "category", "value", F.round("confidence", 6).alias("confidence"))


_URL = "postgres://app:'||substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12)||'@db.example.com/x"


@query(
    f"""SELECT o_orderkey AS doc_id, 1::INTEGER AS ordinal,
  CASE o_orderkey % 4 WHEN 0 THEN 'database' WHEN 1 THEN 'github' WHEN 2 THEN 'aws' ELSE 'openai' END AS category,
  CASE o_orderkey % 4 WHEN 0 THEN '{_URL}'
    WHEN 1 THEN 'ghp_' || substr({hash_sql("o_orderkey")}, 1, 36)
    WHEN 2 THEN 'AKIA' || upper(substr({hash_sql("o_orderkey")}, 1, 16)) || substr({hash_sql("o_orderkey")}, 20, 40)
    ELSE 'zz:sk-' || substr({hash_sql("o_orderkey")}, 1, 24) END AS value
FROM orders"""
)
def overlap_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts on which two rules match overlapping spans."""

    def text(key: Column) -> Column:
        h = hash_of(key)
        turn = F.pmod(key, F.lit(4))
        url = F.concat(
            F.lit("DB_PASSWORD=postgres://app:"), F.substring(h, 1, 12), F.lit("@db.example.com/x")
        )
        azure = F.concat(F.lit("AccountKey=AKIA"), F.upper(F.substring(h, 1, 16)), F.substring(h, 20, 40))
        return (
            F.when(turn == 0, url)
            .when(turn == 1, F.concat(F.lit("const token = 'ghp_"), F.substring(h, 1, 36), F.lit("';")))
            .when(turn == 2, azure)
            .otherwise(F.concat(F.lit("password=zz:sk-"), F.substring(h, 1, 24)))
        )

    return findings(orders_text(spark, sf_dir, text)).select("doc_id", "ordinal", "category", "value")


@query(
    """SELECT o_orderkey AS doc_id, (o_orderkey % 5 + 1)::INTEGER AS line, (o_orderkey % 7 + 3)::INTEGER AS col FROM orders"""
)
def location_line_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text(key: Column) -> Column:
        return F.concat(
            F.repeat(F.lit("é😀\n"), (key % 5).cast("int")),
            F.repeat(F.lit("ß"), (key % 7).cast("int")),
            F.lit("k=AKIA"),
            F.upper(F.substring(hash_of(key), 1, 16)),
        )

    return findings(orders_text(spark, sf_dir, text)).select("doc_id", "line", F.col("column").alias("col"))


@query(
    """SELECT o_orderkey AS doc_id, 2::INTEGER AS line, 'private_key' AS category,
  '-----BEGIN RSA PRIVATE KEY-----' AS value FROM orders"""
)
def private_key_line_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line by line only the marker of a key block is seen."""
    texts = orders_text(spark, sf_dir, lambda key: note(BLOCKS[0], key))
    return findings(texts, scope="line").select("doc_id", "line", "category", "value")


_ENTROPY_SOURCE = f"""SELECT o_orderkey AS doc_id, CASE o_orderkey % 3
  WHEN 0 THEN 'blob ' || to_base64(encode({hash_sql("o_orderkey")}))
  WHEN 1 THEN 'hash ' || md5(CAST(o_orderkey AS VARCHAR)) ELSE 'word ' || repeat('abc', 20) END AS text FROM orders"""


@query(
    detect_sql(_ENTROPY_SOURCE, rule_set(entropy=True))
    + "SELECT doc_id, rule_id, category, value FROM found"
)
def entropy_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text(key: Column) -> Column:
        blob = F.regexp_replace(F.base64(F.encode(hash_of(key), "UTF-8")), "[\r\n]", "")
        return (
            F.when(key % 3 == 0, F.concat(F.lit("blob "), blob))
            .when(key % 3 == 1, F.concat(F.lit("hash "), F.md5(key.cast("string"))))
            .otherwise(F.concat(F.lit("word "), F.repeat(F.lit("abc"), 20)))
        )

    found = findings(orders_text(spark, sf_dir, text), entropy=True)
    return found.select("doc_id", "rule_id", "category", "value")


@query(f"SELECT p_partkey, round({entropy_sql('p_name')}, 6) AS bits FROM part")
def entropy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(shannon_bits(F.col("p_name")), 6).alias("bits"))


@query(
    f"""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN
  CASE WHEN {pick_sql("o_orderkey", lambda p: quote(p.category))} IN
    ({", ".join(quote(r.category) for r in BUILTIN_RULES if r.group == 0)})
  THEN {pick_sql("o_orderkey", lambda p: quote(p.category))} ELSE 'generic' END
  ELSE 'password' END AS category FROM orders"""
)
def classified_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vague findings get a category by the shape of their value, others keep theirs."""
    key = F.col("o_orderkey")
    turn = F.pmod(key, F.lit(len(PLANTS)))
    value = value_of(PLANTS[-1], key)
    for i, plant in reversed(list(enumerate(PLANTS[:-1]))):
        value = F.when(turn == i, value_of(plant, key)).otherwise(value)
    given = F.when(key % 3 == 0, F.lit("generic")).otherwise(F.lit("password"))
    valued = order_keys(spark, sf_dir).select(key.alias("doc_id"), value.alias("value"), given.alias("given"))
    return valued.select("doc_id", classify(F.col("value"), F.col("given")).alias("category"))
