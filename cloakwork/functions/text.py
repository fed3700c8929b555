"""Column functions on text: lines, white space, entities, entropy, number spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = r"\r?\n"
# All Unicode white space and the byte order mark; plain ``\s`` is ASCII only.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def split_lines(text: Column) -> Column:
    """Lines of a text; trailing empty lines are kept."""
    return F.split(text, LINE_BREAK, -1)


def join_lines(lines: Column, original: Column) -> Column:
    """Put lines together again with the line break of the text they came from."""
    return F.when(
        F.contains(original, F.lit("\r\n")), F.array_join(lines, "\r\n")
    ).otherwise(F.array_join(lines, "\n"))


def trim_space(text: Column) -> Column:
    """Strip all white space at both ends (Spark's own ``trim`` strips blanks only)."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def decode_entities(text: Column) -> Column:
    """Undo the five basic HTML entities; the ampersand last, so that nothing is decoded twice."""
    # Entity spellings.
    for entity, char in (
        ("&quot;", '"'),
        ("&#39;", "'"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def encode_entities(text: Column) -> Column:
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def quote_literal(text: Column) -> Column:
    """A regular expression that matches exactly this text."""
    inner = F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), inner, F.lit("\\E"))


def shannon_bits(value: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""
    size = F.length(value)

    def share(char: Column) -> Column:
        return (size - F.length(F.replace(value, char, F.lit("")))) / size

    def add(total: Column, part: Column) -> Column:
        return total - part * F.log2(part)

    shares = F.transform(F.array_distinct(F.split(value, "")), share)
    return F.when(size > 0, F.aggregate(shares, F.lit(0.0), add)).otherwise(F.lit(0.0))


def plain_number(value: Column) -> Column:
    """A double as plain decimal text: ``1`` rather than ``1.0``, no exponent for small fractions."""
    shown = value.cast("string")
    fixed = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"0+$", "")
    return F.regexp_replace(
        F.when(F.contains(shown, F.lit("E")) & (F.abs(value) < 1e15), fixed).otherwise(shown),
        r"\.0?$",
        "",
    )
