"""Writing reports and redacted corpora.

Text reports are written as an ordered set of part files; put together in name order they are the report.
Every report runs through normalisation and redaction, so no raw value reaches a file.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import encode_entities, plain_number
from ..operators.mask import protect
from ..operators.normalise import NORMAL_COLUMNS, csv_line, normalise, redact_findings
from ..plans.report import generated_text, riskiest, summary
from ..session import stored

FORMATS = ("json", "csv", "html")

# The header of the CSV report.
CSV_HEADER = "category,value,risk,confidence,location"
TITLE = "Secret scan report"

_ORDER = ("section", "path", "line", "column", "text")


def _finding_struct() -> Column:
    place = F.struct(F.col("path").alias("filePath"), F.col("line"), F.col("column"))
    detection = F.struct(
        F.col("regex_match").alias("regexMatch"),
        F.col("entropy_score").alias("entropyScore"),
        F.col("context_score").alias("contextScore"),
        F.col("confidence"),
        F.col("risk"),
        F.col("features"),
    )
    return F.struct(
        F.col("value"),
        F.col("category"),
        F.col("path").alias("filePath"),
        F.col("line"),
        F.col("column"),
        place.alias("location"),
        detection.alias("detection"),
    )


def json_findings(findings: DataFrame) -> DataFrame:
    """The findings part of the JSON report, nested as consumers expect it."""
    safe = redact_findings(normalise(findings))
    return safe.select(_finding_struct().alias("f")).select("f.*")


def json_summary(findings: DataFrame) -> DataFrame:
    """The summary part, as one pretty-printed JSON text."""
    one = summary(normalise(findings))
    body = F.struct(
        F.col("total_findings").alias("totalFindings"),
        F.col("risk_distribution").alias("riskDistribution"),
        F.col("score"),
        generated_text().alias("generatedAt"),
    )
    return one.select(F.to_json(body, {"pretty": "true"}).alias("summary"))


def _framed(rows: DataFrame, head: DataFrame, tail: DataFrame | None = None) -> DataFrame:
    parts = [rows.withColumn("section", F.lit(1))]
    for section, frame in ((0, head), (2, tail)):
        if frame is not None:
            empty = {name: F.lit(None).cast(kind) for name, kind in (("path", "string"), ("line", "int"), ("column", "int"))}
            parts.append(frame.select("text", *[c.alias(n) for n, c in empty.items()]).withColumn("section", F.lit(section)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def csv_report(findings: DataFrame) -> DataFrame:
    """Lines of the CSV report with the columns that order them; the header has section 0."""
    safe = redact_findings(normalise(findings))
    rows = safe.select("path", "line", "column", csv_line(safe).alias("text"))
    head = findings.sparkSession.range(1).select(F.lit(CSV_HEADER).alias("text"))
    return _framed(rows, head)


def html_row(category: Column, value: Column, risk: Column, confidence: Column, path: Column) -> Column:
    cells = (category, value, plain_number(risk), plain_number(confidence), path)
    shown = [F.concat(F.lit("<td>"), encode_entities(c), F.lit("</td>")) for c in cells]
    return F.concat(F.lit("<tr>"), *shown, F.lit("</tr>"))


def html_report(findings: DataFrame, top: int | None = None) -> DataFrame:
    """Lines of the HTML report; values are escaped.  ``top`` shows the riskiest findings only, below figures that
    count all of them."""
    known = normalise(findings)
    safe = redact_findings(known)
    if top is not None:
        # In the order of their ranks.
        safe = riskiest(safe, top).withColumn("place", F.lpad(F.col("rank").cast("string"), 10, "0"))
    rows = safe.select(
        F.col("path" if top is None else "place").alias("path"),
        "line",
        "column",
        html_row(*[F.col(c) for c in ("category", "value", "risk", "confidence", "path")]).alias("text"),
    )
    opening = F.concat(
        F.lit(
            f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><title>{TITLE}</title></head>\n'
            f"<body><h1>{TITLE}</h1>\n<p>Generated: "
        ),
        generated_text(),
        F.lit("</p>\n<p>Findings: "),
        F.col("total_findings").cast("string"),
        F.lit("</p>\n<p>Security score: "),
        plain_number(F.col("score")),
        _shown(F.col("total_findings"), top),
        F.lit(
            "</p>\n<table><thead><tr><th>Category</th><th>Value</th><th>Risk</th><th>Confidence</th>"
            "<th>Location</th></tr></thead><tbody>"
        ),
    )
    head = summary(known).select(opening.alias("text"))
    tail = findings.sparkSession.range(1).select(F.lit("</tbody></table></body></html>").alias("text"))
    return _framed(rows, head, tail)


def _shown(total: Column, top: int | None) -> Column:
    if top is None:
        return F.lit("")
    few = F.concat(F.lit(f"</p>\n<p>Shown: the {top} of highest risk; "), (total - top).cast("string"), F.lit(" more in the full report"))
    return F.when(total > top, few).otherwise(F.lit(""))


def html_tables(findings: DataFrame, by: Sequence[str], top: int) -> DataFrame:
    """A short report for each group of columns ``by``, one row each: ``n_findings``, ``score`` and ``html`` with the
    ``top`` riskiest findings of the group."""
    groups = list(by)
    safe = redact_findings(normalise(findings, [c for c in groups if c not in NORMAL_COLUMNS]))
    best = riskiest(safe, top, groups)
    row = html_row(*[F.col(c) for c in ("category", "value", "risk", "confidence", "path")])
    listed = F.array_sort(F.collect_list(F.struct("rank", row.alias("row"))))
    body = best.groupBy(*groups, "n_findings").agg(F.array_join(F.transform(listed, lambda x: x["row"]), "\n").alias("rows"))
    score = F.round(100 - F.least(F.lit(100.0), F.avg(F.col("risk") * 100)), 2)
    scores = safe.groupBy(*groups).agg(score.alias("score"))
    same = reduce(lambda x, y: x & y, [F.col(f"b.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in groups])
    html = F.concat(F.lit("<table><tbody>\n"), F.col("rows"), F.lit("\n</tbody></table>"))
    return body.alias("b").join(scores.alias("s"), same).select("b.*", "s.score").withColumn("html", html).drop("rows")


def write_report(findings: DataFrame, fmt: str, path: str, mode: str = "errorifexists", top: int | None = None) -> None:
    """Write findings as ``json`` (``summary`` and ``findings`` below the path), ``csv`` or ``html``, the last of them
    with the ``top`` riskiest findings only if that is given.

    Findings feed both the summary and the details, so they are stored once, redacted, before either.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, not {fmt!r}")
    findings = stored(redact_findings(normalise(findings)), "report")
    if fmt == "json":
        json_findings(findings).write.mode(mode).json(f"{path}/findings")
        json_summary(findings).write.mode(mode).text(f"{path}/summary")
        return
    lines = csv_report(findings) if fmt == "csv" else html_report(findings, top)
    lines.orderBy(*_ORDER).select("text").write.mode(mode).text(path)


def write_redacted(df: DataFrame, path: str, text_col: str = "text", fmt: str = "parquet", **options) -> int:
    """Write the masked corpus and return how many findings were replaced, counted while writing."""
    seen = Observation()
    columns = [c for c in df.columns if c != text_col]
    masked = protect(df, text_col, **options).observe(
        seen, F.coalesce(F.sum("n_findings"), F.lit(0)).alias("replacements")
    )
    masked.select(*columns, F.col("masked_text").alias(text_col)).write.format(fmt).save(path)
    return seen.get["replacements"]
