"""Replacement tokens: how they are spelled, found and checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from ..operators.catalogue import INLINE_PREFIX, MASK_PREFIX, VAULT_PREFIX

# Shapes of the tokens in text.
MASK_TOKEN = r"\[REDACTED_([a-zA-Z0-9]+)\]"
INLINE_TOKEN = INLINE_PREFIX + r"([A-Za-z0-9+/=\-_]+)(?::([A-Za-z0-9+/=\-_]+))?"
UUID4 = r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"


def mask_token(name: Column) -> Column:
    return F.concat(F.lit(MASK_PREFIX), name, F.lit("]"))


def inline_token(payload: Column) -> Column:
    return F.concat(F.lit(INLINE_PREFIX), payload)


def vault_token(token_id: Column, prefix: str = VAULT_PREFIX) -> Column:
    return F.concat(F.lit(prefix), token_id)


def vault_id(salt: str, *parts: Column) -> Column:
    """An id in the shape of a version-4 UUID, derived so that a retry gives the same id."""

    def shaped(digest: Column) -> Column:
        # The version digit is 4, the variant digit one of 8, 9, a, b.
        variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
        return F.concat(
            F.substring(digest, 1, 8),
            F.lit("-"),
            F.substring(digest, 9, 4),
            F.lit("-4"),
            F.substring(digest, 14, 3),
            F.lit("-"),
            variant,
            F.substring(digest, 18, 3),
            F.lit("-"),
            F.substring(digest, 21, 12),
        )

    return let(F.sha2(F.concat_ws("\u0001", F.lit(salt), *parts), 256), shaped)


def token_id(token: Column, prefix: str = VAULT_PREFIX, strict: bool = False) -> Column:
    """The id after the prefix; null for anything else, or an error if ``strict``."""
    found = F.nullif(F.regexp_extract(token, prefix + "(.+)", 1), F.lit(""))
    if not strict:
        return found
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit("not a vault token")))


def is_vault_token(token: Column, prefix: str = VAULT_PREFIX) -> Column:
    return token.rlike(f"(?i)^{prefix}{UUID4}\\z")
