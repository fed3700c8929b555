"""Reports and aggregates over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators.detect import findings
from ...operators.normalise import csv_line, normalise, redact_findings
from ...session import scratch_dir, stored
from ...sources.corpus import spread
from ...sources.reports import (
    csv_report,
    html_report,
    json_findings,
    json_summary,
    write_redacted,
    write_report,
)
from .. import report
from ..oracle import WRAPPED_DOCUMENTS, detect_sql, masked_sql
from ..planted import wrapped
from .common import query, table, wrapped_documents


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat findings with gaps, one per line item."""
    number = F.col("l_linenumber")
    items = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_discount", "l_tax"
    )
    return spread(items).select(
        F.when(number % 3 != 0, F.concat(F.lit('src/a,"'), F.col("l_suppkey").cast("string"), F.lit('".env'))).alias("filePath"),
        F.when(number % 2 == 0, number).alias("line"),
        F.when(F.col("l_returnflag") != "A", F.concat(F.lit("kind-"), F.col("l_returnflag"))).alias("category"),
        F.when(number % 4 == 0, F.lit(None))
        .when(number % 4 == 1, F.concat(F.lit("[REDACTED_"), F.col("l_partkey").cast("string"), F.lit("]")))
        .otherwise(F.concat(F.lit("raw "), F.col("l_partkey").cast("string")))
        .alias("redactedValue"),
        F.when(number % 5 != 0, F.col("l_discount")).alias("riskScore"),
        F.when(number % 5 != 1, F.col("l_tax")).alias("confidence"),
    )


_LOOSE = """WITH loose AS (
  SELECT coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN 'src/a,"' || l_suppkey || '".env' END, 'clipboard') AS path,
    CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS line,
    coalesce(CASE WHEN l_returnflag <> 'A' THEN 'kind-' || l_returnflag END, 'unknown') AS category,
    coalesce(CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN '[REDACTED_' || l_partkey || ']'
      ELSE 'raw ' || l_partkey END, '[REDACTED]') AS raw_value,
    coalesce(CASE WHEN l_linenumber % 5 <> 0 THEN l_discount END, 0.0) AS risk,
    coalesce(CASE WHEN l_linenumber % 5 <> 1 THEN l_tax END, 0.5) AS confidence
  FROM lineitem),
safe AS (
  SELECT *, CASE WHEN contains(raw_value, '[REDACTED') THEN raw_value ELSE '[REDACTED_' || category || ']' END AS value
  FROM loose)
"""


def _shown_line() -> Column:
    """0 where there is none, so that results compare as whole numbers."""
    return F.coalesce("line", F.lit(0)).alias("line")


@query(
    _LOOSE
    + """SELECT raw_value AS value, category, path, coalesce(line, 0)::INTEGER AS line, TRUE AS no_column, TRUE AS regex_match,
  0.0::DOUBLE AS entropy_score, 0.0::DOUBLE AS context_score, confidence, risk, 0::INTEGER AS n_features FROM safe"""
)
def normalised_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(_loose(spark, sf_dir)).select(
        "value", "category", "path", _shown_line(), F.col("column").isNull().alias("no_column"), "regex_match",
        "entropy_score", "context_score", "confidence", "risk", F.size("features").alias("n_features"),
    )


@query(_LOOSE + "SELECT value, category, path, coalesce(line, 0)::INTEGER AS line, risk FROM safe")
def redacted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = redact_findings(normalise(_loose(spark, sf_dir)))
    return safe.select("value", "category", "path", _shown_line(), "risk")


def _plain_sql(value: str) -> str:
    return f"regexp_replace(CAST({value} AS VARCHAR), '\\.0$', '')"


_CSV = f"""SELECT category || ',' || value || ',' || {_plain_sql("risk")} || ',' || {_plain_sql("confidence")} || ',' ||
  CASE WHEN contains(loc, '"') THEN '"' || replace(loc, '"', '""') || '"' ELSE loc END AS text
FROM (SELECT *, path || CASE WHEN line IS NULL THEN '' ELSE ':' || line END AS loc FROM safe)"""


@query(_LOOSE + _CSV)
def csv_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = redact_findings(normalise(_loose(spark, sf_dir)))
    return safe.select(csv_line(safe).alias("text"))


@query(
    _LOOSE
    + f"""SELECT 0::INTEGER AS section, 'category,value,risk,confidence,location' AS text
UNION ALL SELECT 1::INTEGER, text FROM ({_CSV})"""
)
def csv_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_report(_loose(spark, sf_dir)).select("section", "text")


@query(
    _LOOSE
    + f"""SELECT '<tr><td>' || category || '</td><td>' || value || '</td><td>' || {_plain_sql("risk")} || '</td><td>' ||
  {_plain_sql("confidence")} || '</td><td>' || replace(path, '"', '&quot;') || '</td></tr>' AS text FROM safe"""
)
def html_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_report(_loose(spark, sf_dir)).where("section = 1").select("text")


@query(
    _LOOSE
    + """SELECT value, category, path AS file_path, path AS location_path, coalesce(line, 0)::INTEGER AS location_line,
  confidence, risk, TRUE AS regex_match FROM safe"""
)
def json_report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_findings(_loose(spark, sf_dir)).select(
        "value",
        "category",
        F.col("filePath").alias("file_path"),
        F.col("location.filePath").alias("location_path"),
        F.coalesce("location.line", F.lit(0)).alias("location_line"),
        F.col("detection.confidence").alias("confidence"),
        F.col("detection.risk").alias("risk"),
        F.col("detection.regexMatch").alias("regex_match"),
    )


_RANKED = "ORDER BY risk DESC, path NULLS FIRST, line NULLS FIRST, category, value, confidence"


@query(
    _LOOSE
    + f"""SELECT category, path, coalesce(line, 0)::INTEGER AS line, value, risk, rank::INTEGER AS rank, n_findings FROM (
  SELECT *, row_number() OVER (PARTITION BY category {_RANKED}) AS rank, count(*) OVER (PARTITION BY category) AS n_findings FROM safe)
WHERE rank <= 25"""
)
def riskiest_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = redact_findings(normalise(_loose(spark, sf_dir)))
    best = report.riskiest(safe, 25, by=["category"])
    return best.select("category", "path", _shown_line(), "value", "risk", "rank", "n_findings")


@query(
    _LOOSE
    + f"""SELECT '<tr><td>' || category || '</td><td>' || value || '</td><td>' || {_plain_sql("risk")} || '</td><td>' ||
  {_plain_sql("confidence")} || '</td><td>' || replace(path, '"', '&quot;') || '</td></tr>' AS text
FROM (SELECT * FROM safe {_RANKED} LIMIT 100)"""
)
def html_report_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of readable size: the hundred findings of highest risk."""
    return html_report(_loose(spark, sf_dir), top=100).where("section = 1").select("text")


_STATES = 5


@query(
    detect_sql(WRAPPED_DOCUMENTS)
    + """SELECT count(*)::BIGINT AS total_findings, round(100 - least(100, sum(round(risk * 100)) / count(*)), 2) AS score, max(risk) AS max_risk,
  count(DISTINCT category)::INTEGER AS categories, TRUE AS secrets_close FROM found"""
)
def merged_report_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of five parts of the corpus, merged; the number of distinct secrets is within 3 percent of the count."""
    # States and the exact count read the findings that were looked for once; what was found stays behind.
    found = stored(findings(wrapped_documents(spark, sf_dir)).select("doc_id", "category", "risk", "fingerprint"), "findings")
    parts = report.report_state(found.withColumn("run", F.pmod("doc_id", F.lit(_STATES))), by=["run"])
    one = report.state_summary(parts.drop("run"))
    exact = found.agg(F.count_distinct("fingerprint").alias("exact")).withColumn("k", F.lit(1))
    both = one.withColumn("k", F.lit(1)).join(exact, "k")
    close = F.abs(F.col("distinct_secrets") - F.col("exact")) <= F.col("exact") * 0.03
    return both.select("total_findings", "score", "max_risk", F.size("risk_distribution").alias("categories"), close.alias("secrets_close"))


def _flat_summary(found: DataFrame) -> DataFrame:
    one = report.summary(found)
    pairs = F.transform(
        F.array_sort(F.map_entries("risk_distribution")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return one.select("total_findings", "score", F.array_join(pairs, ", ").alias("risk_distribution"))


def _summary_sql(source: str) -> str:
    return f"""SELECT sum(n)::BIGINT AS total_findings, round(100 - least(100, sum(r) / sum(n)), 2) AS score,
  string_agg(category || '=' || n, ', ' ORDER BY category) AS risk_distribution
FROM (SELECT category, count(*) AS n, sum(risk * 100) AS r FROM {source} GROUP BY category)"""


@query(detect_sql(WRAPPED_DOCUMENTS) + _summary_sql("found"))
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_summary(findings(wrapped_documents(spark, sf_dir)))


@query(_LOOSE + _summary_sql("safe"))
def loose_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_summary(normalise(_loose(spark, sf_dir)))


@query(
    detect_sql(WRAPPED_DOCUMENTS)
    + """SELECT source, count(*) AS n_findings, round(100 - least(100, avg(risk * 100)), 2) AS score
FROM found JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source"""
)
def security_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each source of documents."""
    text = wrapped(F.col("text"), F.col("doc_id"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    docs = docs.select("doc_id", "source", text.alias("text"))
    found = findings(docs, id_cols=["doc_id", "source"])
    score = F.round(100 - F.least(F.lit(100.0), F.avg(F.col("risk") * 100)), 2)
    return found.groupBy("source").agg(F.count("*").alias("n_findings"), score.alias("score"))


@query(
    detect_sql(WRAPPED_DOCUMENTS)
    + """SELECT 'corpus/' || doc_id || '.txt' AS path, count(*) AS n_findings, max(risk) AS max_risk
FROM found GROUP BY doc_id"""
)
def findings_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("corpus/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = wrapped_documents(spark, sf_dir).withColumn("path", path)
    return report.per_file(findings(docs, path_col="path"))


@query(masked_sql(WRAPPED_DOCUMENTS) + "SELECT doc_id, masked_text AS text FROM masked")
def redacted_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked corpus as written."""
    path = scratch_dir(spark, "redacted")
    write_redacted(wrapped_documents(spark, sf_dir), path)
    return spark.read.parquet(path)


@query(_LOOSE + f"SELECT 'category,value,risk,confidence,location' AS text UNION ALL {_CSV}")
def written_csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "csv")
    write_report(_loose(spark, sf_dir), "csv", path)
    return spark.read.text(path).select(F.col("value").alias("text"))


@query(_LOOSE + "SELECT value, category, path, coalesce(line, 0)::BIGINT AS line, risk FROM safe")
def written_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "json")
    write_report(_loose(spark, sf_dir), "json", path)
    schema = "value string, category string, filePath string, line long, detection struct<risk:double>"
    found = spark.read.schema(schema).json(f"{path}/findings")
    return found.select("value", "category", F.col("filePath").alias("path"), _shown_line(), "detection.risk")


@query(
    detect_sql(WRAPPED_DOCUMENTS)
    + """SELECT count(*)::BIGINT AS total_findings, round(100 - least(100, avg(risk * 100)), 2) AS score,
  count(DISTINCT category)::INTEGER AS categories FROM found"""
)
def json_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pretty-printed summary, parsed again."""
    schema = "totalFindings long, score double, riskDistribution map<string,long>"
    parsed = json_summary(findings(wrapped_documents(spark, sf_dir))).select(F.from_json("summary", schema).alias("s"))
    return parsed.select(
        F.col("s.totalFindings").alias("total_findings"), "s.score", F.size("s.riskDistribution").alias("categories")
    )
