"""Findings from elsewhere, brought into one shape and made safe to show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import plain_number
from ..functions.tokens import mask_token
from .catalogue import MASK_OPEN

NO_PATH = "clipboard"
NO_VALUE = "[REDACTED]"

# Where each field may come from, the first that is not null winning.
_SOURCES = {
    "value": ("value", "redactedValue", "redacted_value"),
    "category": ("category",),
    "path": ("path", "filePath", "location.filePath", "location.path"),
    "line": ("line", "location.line"),
    "column": ("column", "location.column"),
    "regex_match": ("regex_match", "detection.regexMatch", "detection.regex_match"),
    "entropy_score": ("entropy_score", "detection.entropyScore", "detection.entropy_score"),
    "context_score": ("context_score", "detection.contextScore", "detection.context_score"),
    "confidence": ("detection.confidence", "confidence"),
    "risk": ("detection.risk", "risk", "riskScore", "risk_score"),
    "features": ("features", "detection.features"),
}

NORMAL_COLUMNS = tuple(_SOURCES)

_TYPES = {
    "value": "string",
    "category": "string",
    "path": "string",
    "line": "int",
    "column": "int",
    "regex_match": "boolean",
    "entropy_score": "double",
    "context_score": "double",
    "confidence": "double",
    "risk": "double",
    "features": "array<string>",
}


def _defaults() -> dict[str, Column]:
    return {
        "value": F.lit(NO_VALUE),
        "category": F.lit("unknown"),
        "path": F.lit(NO_PATH),
        "regex_match": F.lit(True),
        "entropy_score": F.lit(0.0),
        "context_score": F.lit(0.0),
        "confidence": F.lit(0.5),
        "risk": F.lit(0.0),
        "features": F.array().cast("array<string>"),
    }


def _has(schema: T.StructType, name: str) -> bool:
    head, _, rest = name.partition(".")
    if head not in schema.fieldNames():
        return False
    inner = schema[head].dataType
    return not rest or (isinstance(inner, T.StructType) and _has(inner, rest))


def normalise(df: DataFrame, id_cols: Sequence[str] = ()) -> DataFrame:
    """Flat or nested findings, with missing fields defaulted; other columns are dropped but ``id_cols``."""
    defaults = _defaults()

    def field(name: str) -> Column:
        found = [F.col(source).cast(_TYPES[name]) for source in _SOURCES[name] if _has(df.schema, source)]
        if name in defaults:
            found.append(defaults[name])
        return F.coalesce(*found) if found else F.lit(None).cast(_TYPES[name])

    return df.select(*id_cols, *[field(name).alias(name) for name in _SOURCES])


def safe_value(value: Column, category: Column) -> Column:
    """A value fit for a report: kept when already redacted, otherwise the mask of its category."""
    return F.when(F.contains(value, F.lit(MASK_OPEN)), value).otherwise(mask_token(category))


def redact_findings(df: DataFrame) -> DataFrame:
    """Normalised findings without raw values; the last projection before any report."""
    return df.withColumn("value", safe_value(F.col("value"), F.col("category")))


def location_text(path: Column, line: Column) -> Column:
    shown = F.when(line > 0, F.concat(F.lit(":"), line.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.coalesce(path, F.lit(NO_PATH)), shown)


def csv_cell(text: Column) -> Column:
    flat = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"\r?\n", " ")).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))
    special = F.contains(text, F.lit('"')) | F.contains(text, F.lit(","))
    return F.when(special, quoted).otherwise(flat)


def csv_line(df: DataFrame) -> Column:
    """One report line of a redacted, normalised finding."""
    return F.concat_ws(
        ",",
        csv_cell(df["category"]),
        csv_cell(df["value"]),
        plain_number(df["risk"]),
        plain_number(df["confidence"]),
        csv_cell(location_text(df["path"], df["line"])),
    )
