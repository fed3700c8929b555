"""Scores of a finding: entropy, context, confidence, risk, feature tags, category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import shannon_bits
from .catalogue import BUILTIN_RULES, Rule

# Words whose neighbourhood makes a match more credible.
CONTEXT_WORDS = r"(?i)key|secret|token|passw|pwd|credential|auth|bearer"
# A file or URL path; as a custom finding it is almost certainly harmless.
PATH_LIKE = r"^/?[\w.-]+(/[\w.-]+)+$"
PATH_CONFIDENCE = 0.2


def entropy_of(value: Column) -> Column:
    """Bits per character on a 0..1 scale, 5 bits and more counting as 1."""
    return F.least(F.lit(1.0), shannon_bits(value) / 5)


def context_of(window: Column) -> Column:
    """1 when the text before the value names a secret, else 0."""
    return F.when(window.rlike(CONTEXT_WORDS), F.lit(1.0)).otherwise(F.lit(0.0))


def confidence_of(
    value: Column, category: Column, base: Column, entropy: Column, context: Column
) -> Column:
    scored = F.least(F.lit(1.0), base + entropy * 0.1 + context * 0.1)
    return F.when((category == "custom") & value.rlike(PATH_LIKE), F.lit(PATH_CONFIDENCE)).otherwise(scored)


def risk_of(severity: Column, confidence: Column) -> Column:
    return F.round(severity * confidence, 2)


def features_of(regex: Column, entropy: Column, context: Column) -> Column:
    """Which signals spoke for the finding; the entropy tag needs 3 bits per character."""
    return F.array_compact(
        F.array(
            F.when(regex, F.lit("regex")),
            F.when(entropy >= 0.6, F.lit("entropy")),
            F.when(context > 0, F.lit("context")),
        )
    )


def classify(value: Column, category: Column, rules: Sequence[Rule] = BUILTIN_RULES) -> Column:
    """Keep a specific category; give ``generic`` and missing ones the first provider shape that fits."""
    guess = F.lit(None).cast("string")
    for rule in reversed([r for r in rules if r.group == 0]):
        guess = F.when(value.rlike(f"^(?:{rule.pattern})$"), F.lit(rule.category)).otherwise(guess)
    vague = category.isNull() | category.isin("generic", "unknown")
    return F.when(vague, F.coalesce(guess, category, F.lit("generic"))).otherwise(category)
