"""Measuring detection on labelled texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.catalogue import Rule
from ..operators.detect import found_in


def evaluate(
    samples: DataFrame, text_col: str = "text", custom: Sequence[Rule] = (), scope: str = "document"
) -> DataFrame:
    """Add ``detected`` to samples labelled ``should_detect``."""
    return samples.withColumn("detected", F.size(found_in(text_col, custom, scope)) > 0)


def _count(when: Column) -> Column:
    return F.count(F.when(when, F.lit(1)))


def _ratio(part: Column, rest: Column) -> Column:
    return F.coalesce(part / F.nullif(part + rest, F.lit(0)), F.lit(0.0))


def confusion(evaluated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the four outcomes, precision, recall and false-positive rate; a ratio over nothing is 0."""
    should, found = F.col("should_detect"), F.col("detected")
    counts = evaluated.groupBy(*by).agg(
        _count(should & found).alias("tp"),
        _count(~should & found).alias("fp"),
        _count(should & ~found).alias("fn"),
        _count(~should & ~found).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by,
        "tp",
        "fp",
        "fn",
        "tn",
        _ratio(tp, fp).alias("precision"),
        _ratio(tp, fn).alias("recall"),
        _ratio(fp, tn).alias("fp_rate"),
    )


def missed(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(F.col("should_detect") & ~F.col("detected"))
