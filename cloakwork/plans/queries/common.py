"""What the queries share: where they register, their tables and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...sources.corpus import spread
from ..oracle import wrapped_sql
from ..planted import wrapped

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Any fixed key does for a check: results never show ciphertext.
KEY = bytes(range(32))
OTHER_KEY = bytes(range(1, 33))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def wrapped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a secret planted in a line below it."""
    return documents(spark, sf_dir).select("doc_id", wrapped(F.col("text"), F.col("doc_id")).alias("text"))


# Keys of which one task makes texts at most: a key is cheap to move, what is made of it as dear to scan as any text.
KEYS_PER_TASK = 20_000


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders").select("o_orderkey"), KEYS_PER_TASK)


def orders_text(spark: SparkSession, sf_dir: str, text: Callable[[Column], Column]) -> DataFrame:
    """One text per order, made from its key."""
    key = F.col("o_orderkey")
    return order_keys(spark, sf_dir).select(key.alias("doc_id"), text(key).alias("text"))


DOCUMENTS = "SELECT doc_id, text FROM documents"

CONVERSATIONS = (
    "SELECT conv_id * 1000 + turn AS doc_id, "
    + wrapped_sql("text", "(conv_id * 1000 + turn)")
    + " AS text FROM conversations"
)


def messages_text(rows: DataFrame) -> DataFrame:
    key = F.col("conv_id") * 1000 + F.col("turn")
    return rows.select(key.alias("doc_id"), wrapped(F.col("text"), key).alias("text"))
