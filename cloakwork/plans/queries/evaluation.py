"""Detection measured on labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..evaluate import confusion, evaluate, missed
from ..planted import any_line, hash_of
from .common import order_keys, query


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts: real secrets, harmless look-alikes, fixtures (found but harmless), keys cut short."""
    key = F.col("o_orderkey")
    h = hash_of(key)
    turn = F.pmod(key, F.lit(8))
    uuid = F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)
    )
    text = (
        F.when(turn < 4, any_line(key))
        .when(turn == 4, F.concat(F.lit("const uuid = '"), uuid, F.lit("';")))
        .when(turn == 5, F.concat(F.lit("const hash = '"), F.substring(h, 1, 32), F.lit("';")))
        .when(turn == 6, F.concat(F.lit("fixture AKIA"), F.upper(F.substring(h, 1, 16))))
        .otherwise(F.concat(F.lit("cut sk-"), F.substring(h, 1, 8)))
    )
    kind = (
        F.when(turn < 4, F.lit("secret")).when(turn == 4, F.lit("uuid")).when(turn == 5, F.lit("hash"))
        .when(turn == 6, F.lit("fixture")).otherwise(F.lit("cut"))
    )
    return order_keys(spark, sf_dir).select(
        key.alias("doc_id"), text.alias("text"), ((turn < 4) | (turn == 7)).alias("should_detect"), kind.alias("category")
    )


_OUTCOMES = """WITH outcome AS (
  SELECT o_orderkey AS doc_id, o_orderkey % 8 < 4 OR o_orderkey % 8 = 7 AS should_detect,
    o_orderkey % 8 < 4 OR o_orderkey % 8 = 6 AS detected,
    CASE WHEN o_orderkey % 8 < 4 THEN 'secret' WHEN o_orderkey % 8 = 4 THEN 'uuid' WHEN o_orderkey % 8 = 5 THEN 'hash'
      WHEN o_orderkey % 8 = 6 THEN 'fixture' ELSE 'cut' END AS category FROM orders),
counts AS (
  SELECT {by} count(*) FILTER (WHERE should_detect AND detected) AS tp,
    count(*) FILTER (WHERE NOT should_detect AND detected) AS fp,
    count(*) FILTER (WHERE should_detect AND NOT detected) AS fn,
    count(*) FILTER (WHERE NOT should_detect AND NOT detected) AS tn FROM outcome {group})
SELECT {by} tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision,
  coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, coalesce(fp / nullif(fp + tn, 0), 0)::DOUBLE AS fp_rate
FROM counts"""


@query(_OUTCOMES.format(by="", group=""))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(evaluate(_samples(spark, sf_dir)))


@query(_OUTCOMES.format(by="category,", group="GROUP BY category"))
def per_category_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(evaluate(_samples(spark, sf_dir)), by=["category"])


@query("SELECT o_orderkey AS doc_id, 'cut' AS category FROM orders WHERE o_orderkey % 8 = 7")
def missed_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missed(evaluate(_samples(spark, sf_dir))).select("doc_id", "category")
