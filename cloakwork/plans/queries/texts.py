"""Lines, line breaks and small column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.text import join_lines, plain_number, split_lines, trim_space
from ...operators.mask import mask
from ...session import stored
from ..planted import PLANTS, hash_of, line_of
from .common import documents, orders_text, query, table, wrapped_documents


@query(
    """SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1)::INTEGER AS line_no
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""
)
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("i", "line"))
    return lines.select("doc_id", "line", (F.col("i") + 1).alias("line_no"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(13)||chr(10)) ELSE text END AS text
FROM documents"""
)
def line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    mixed = documents(spark, sf_dir).select("doc_id", text.alias("text"))
    return mixed.select("doc_id", join_lines(split_lines(F.col("text")), F.col("text")).alias("text"))


def _crlf_sql(value: str) -> str:
    return f"""SELECT o_orderkey AS doc_id, 'a' || chr(13)||chr(10) || 'password = ''' || {value} || '''' ||
  chr(13)||chr(10) || 'end' || chr(13)||chr(10) AS masked_text FROM orders"""


@query(_crlf_sql("'[REDACTED_password]'"))
def crlf_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    plant = next(p for p in PLANTS if p.category == "password")

    def text(key: Column) -> Column:
        return F.concat(F.lit("a\r\n"), line_of(plant, key), F.lit("\r\nend\r\n"))

    return mask(orders_text(spark, sf_dir, text)).select("doc_id", "masked_text")


@query(
    """SELECT o_orderkey AS doc_id, 'password=[REDACTED_password] again [REDACTED_password]x' || chr(10)
  || 'p' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12) AS masked_text, 1::INTEGER AS n_findings FROM orders"""
)
def repeats_in_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence in the line goes, other lines are left alone."""

    def text(key: Column) -> Column:
        value = F.concat(F.lit("p"), F.substring(hash_of(key), 1, 12))
        return F.concat(F.lit("password="), value, F.lit(" again "), value, F.lit("x\n"), value)

    return mask(orders_text(spark, sf_dir, text)).select("doc_id", "masked_text", "n_findings")


@query("SELECT doc_id, TRUE AS stable FROM documents")
def masking_is_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = stored(mask(wrapped_documents(spark, sf_dir)).select("doc_id", F.col("masked_text").alias("text")), "once")
    return mask(once).select("doc_id", (F.col("masked_text") == F.col("text")).alias("stable"))


@query("SELECT c_custkey, c_name AS trimmed FROM customer")
def trimmed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("\t  "), F.col("c_name"), F.lit("　\r\n"))
    return table(spark, sf_dir, "customer").select("c_custkey", trim_space(padded).alias("trimmed"))


@query(
    """SELECT c_custkey, regexp_replace(CAST(round(c_acctbal) AS VARCHAR), '\\.0$', '') AS whole,
  regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') AS plain FROM customer"""
)
def plain_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", plain_number(F.round(balance)).alias("whole"), plain_number(balance).alias("plain")
    )
