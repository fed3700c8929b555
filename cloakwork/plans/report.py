"""Aggregates over findings."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("n_findings"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: total, count per category, security score, time of the report.

    The score is 100 less the mean risk in percent, and 100 without findings.  Findings are aggregated per
    category on the map side first; what meets in one task is one row per category.
    """
    per_category = findings.groupBy("category").agg(
        F.count("*").alias("n"), F.sum(F.col("risk") * 100).alias("risk")
    )
    counts = F.array_sort(F.collect_list(F.struct("category", "n")))
    total = F.coalesce(F.sum("n"), F.lit(0))
    mean = F.sum("risk") / F.sum("n")
    score = F.round(100 - F.least(F.lit(100.0), mean), 2)
    return per_category.agg(
        total.alias("total_findings"),
        F.map_from_entries(counts).alias("risk_distribution"),
        F.when(total > 0, score).otherwise(F.lit(100.0)).alias("score"),
    ).withColumn("generated_at", F.current_timestamp())


def generated_text():
    """Time of the report as ISO text in UTC."""
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def max_risk(findings: DataFrame, id_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    return findings.groupBy(*id_cols).agg(F.max("risk").alias("max_risk"))


def per_file(findings: DataFrame) -> DataFrame:
    """Findings per file, gathered across files."""
    return findings.groupBy("path").agg(
        F.count("*").alias("n_findings"), F.max("risk").alias("max_risk")
    )


def repeated_secrets(findings: DataFrame) -> DataFrame:
    """How often each secret occurs, by fingerprint; the value itself is not needed."""
    return findings.groupBy("fingerprint", "category").agg(F.count("*").alias("n_findings"))


def riskiest(findings: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` riskiest findings of each group of columns ``by``, or of all, with ``rank`` and ``n_findings``, the
    full number in the group; ties go by place, missing places first.

    Each task keeps no more than ``n`` of a group before anything is shuffled, so a group with most of the
    findings costs ``n`` rows a task, and there is no sort of all findings.
    """
    order = [F.desc("risk"), *[F.asc(c) for c in ("path", "line", "column", "category", "value", "confidence")]]
    groups = list(by) or ["__cw_all"]
    rows = findings if by else findings.withColumn("__cw_all", F.lit(0))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= n)
    counts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_findings"))
    same = reduce(lambda x, y: x & y, [F.col(f"f.`{c}`").eqNullSafe(F.col(f"c.`{c}`")) for c in groups])
    return ranked.alias("f").join(counts.alias("c"), same).select("f.*", "c.n_findings").drop("__cw_all")


# States of a report that can be added up: over runs, over parts of a corpus, over micro-batches.

_SKETCH_BITS = 14  # distinct secrets within about 1 percent


def report_state(findings: DataFrame, by: Sequence[str] = (), fingerprint_col: str = "fingerprint") -> DataFrame:
    """What a report needs of some findings, by category and the columns ``by``: how many, their risk in hundredths, the
    highest risk, and a sketch of distinct secrets.  A few kilobytes a category, however many findings."""
    sketch = F.hll_sketch_agg(fingerprint_col, F.lit(_SKETCH_BITS))
    hundredths = F.sum(F.round(F.col("risk") * 100).cast("long"))
    return findings.groupBy(*by, "category").agg(
        F.count(F.lit(1)).alias("n"), hundredths.alias("risk"), F.max("risk").alias("max_risk"), sketch.alias("secrets")
    )


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state out of several in one table; merging is associative, and the same whatever the order."""
    return states.groupBy(*by, "category").agg(
        F.sum("n").alias("n"), F.sum("risk").alias("risk"), F.max("max_risk").alias("max_risk"), F.hll_union_agg("secrets").alias("secrets")
    )


def state_summary(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The summary of a state: ``total_findings``, ``risk_distribution``, ``score``, ``max_risk``, ``distinct_secrets``.

    Risks count as hundredths, which is how findings have them, so sums are exact.
    """
    counts = F.array_sort(F.collect_list(F.struct("category", "n")))
    total = F.coalesce(F.sum("n"), F.lit(0))
    mean = F.sum("risk") / F.sum("n")
    score = F.when(total > 0, F.round(100 - F.least(F.lit(100.0), mean), 2)).otherwise(F.lit(100.0))
    return merge_states(state, by).groupBy(*by).agg(
        total.alias("total_findings"),
        F.map_from_entries(counts).alias("risk_distribution"),
        score.alias("score"),
        F.max("max_risk").alias("max_risk"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("secrets")), F.lit(0)).alias("distinct_secrets"),
    )
