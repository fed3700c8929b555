"""Restoring masked text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.crypto import unseal
from ..functions.tokens import INLINE_TOKEN, MASK_TOKEN, UUID4
from .catalogue import VAULT_PREFIX

MAP = "__cw_map"


def _weave(text: Column, pattern: str, restore: Callable[[Column], Column]) -> Column:
    """Replace each token by ``restore(token)``, or leave it where that is null; count both."""

    def woven(t: Column, tokens: Column) -> Column:
        parts = F.zip_with(
            F.split(t, pattern, -1),
            tokens,
            lambda gap, x: F.concat(gap, F.coalesce(x["plain"], x["token"], F.lit(""))),
        )
        back = F.filter(tokens, lambda x: x["plain"].isNotNull())
        return F.struct(
            F.when(F.size(tokens) > 0, F.array_join(parts, "")).otherwise(t).alias("restored_text"),
            F.coalesce(F.size(tokens), F.lit(0)).alias("tokens_seen"),
            F.coalesce(F.size(back), F.lit(0)).alias("tokens_restored"),
        )

    def tokens_in(t: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
            lambda token: F.struct(token.alias("token"), restore(token).alias("plain")),
        )

    return let(text, lambda t: let(tokens_in(t), lambda tokens: woven(t, tokens)))


def unmask_inline(df: DataFrame, key: bytes, text_col: str = "masked_text") -> DataFrame:
    """Decrypt the tokens that carry their own ciphertext.

    Adds ``restored_text``, ``tokens_seen`` and ``tokens_restored``.  A token may have a second part after a
    colon, which belongs to the payload; if it does not decrypt that way, the part is taken as plain text.
    """

    def restore(token: Column) -> Column:
        first = F.regexp_extract(token, INLINE_TOKEN, 1)
        second = F.regexp_extract(token, INLINE_TOKEN, 2)
        alone = F.concat(unseal(first, key), F.when(second == "", F.lit("")).otherwise(F.concat(F.lit(":"), second)))
        return F.coalesce(unseal(F.concat(first, second), key), alone)

    keep = [F.col(f"`{c}`") for c in df.columns]
    restored = _weave(F.col(text_col), INLINE_TOKEN, restore)
    return df.select(*keep, restored.alias("__cw")).select(*keep, "__cw.*")


def restored_by_map(df: DataFrame, pattern: str, token_id: Callable[[Column], Column], key: bytes, text_col: str):
    def restore(token: Column) -> Column:
        return unseal(F.element_at(F.col(MAP), token_id(token)), key)

    keep = [F.col(f"`{c}`") for c in df.columns if c != MAP]
    restored = _weave(F.col(text_col), pattern, restore)
    return df.select(*keep, restored.alias("__cw")).select(*keep, "__cw.*")


def untouched(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col(text_col).alias("restored_text"),
        F.lit(0).alias("tokens_seen"),
        F.lit(0).alias("tokens_restored"),
    )


def payload_map(rows: Column) -> Column:
    """Sorted distinct ``(token_id, payload)`` as a map.

    A token id that comes twice with one payload (a replayed write) counts once; one that comes with different
    payloads says nothing, so its tokens stay in the text.
    """

    def alone(x: Column, i: Column) -> Column:
        beside = [F.when(i > 0, F.get(rows, i - 1)["token_id"]), F.get(rows, i + 1)["token_id"]]
        return ~F.coalesce(beside[0] == x["token_id"], F.lit(False)) & ~F.coalesce(beside[1] == x["token_id"], F.lit(False))

    return F.map_from_entries(F.filter(rows, alone))


def _entries(vault: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Payloads by token id as one map per row key, in one shuffle."""
    rows = F.array_sort(F.collect_set(F.struct("token_id", "payload")))
    return vault.groupBy(*ids).agg(rows.alias("rows")).select(*ids, payload_map(F.col("rows")).alias(MAP))


def unmask_numbered(
    df: DataFrame,
    vault: DataFrame,
    key: bytes,
    text_col: str = "masked_text",
    id_cols: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Restore ``[REDACTED_<id>]`` tokens from the vault rows of the same document.

    ``id_cols`` must identify a row of ``df``.  Only texts that hold a token are shuffled; the others pass
    by.  Tokens without a vault row, or whose payload does not decrypt, stay as they are.
    """
    ids = list(id_cols)
    has_token = F.coalesce(F.col(text_col).rlike(MASK_TOKEN), F.lit(False))
    maps = _entries(vault, ids)
    joined = df.where(has_token).join(maps, ids, "left")
    ordered = joined.select(*[F.col(f"`{c}`") for c in df.columns], F.col(MAP))
    done = restored_by_map(
        ordered, MASK_TOKEN, lambda token: F.regexp_extract(token, MASK_TOKEN, 1), key, text_col
    )
    return done.unionByName(untouched(df.where(~has_token), text_col))


def unmask_vault(
    df: DataFrame,
    vault: DataFrame,
    key: bytes,
    text_col: str = "masked_text",
    id_cols: Sequence[str] = ("doc_id",),
    prefix: str = VAULT_PREFIX,
) -> DataFrame:
    """Restore reference tokens, wherever they were pasted: the token id alone finds the vault row.

    Only (row key, token id) pairs meet the vault, not the texts.
    """
    ids = list(id_cols)
    pattern = f"(?i){prefix}({UUID4})"
    has_token = F.coalesce(F.col(text_col).rlike(pattern), F.lit(False))
    masked = df.where(has_token)

    def name(token: Column) -> Column:
        return F.lower(F.regexp_extract(token, pattern, 1))

    tokens = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))
    pairs = masked.select(
        *ids, F.explode(F.array_distinct(F.transform(tokens, lambda t: F.lower(t)))).alias("token_id")
    )
    # Joined as they are, without an aggregate on either side: so a token that turns up in very many texts
    # is split over several tasks by the adaptive skew handling of the join.
    maps = _entries(pairs.join(vault.select("token_id", "payload"), "token_id"), ids)
    joined = masked.join(maps, ids, "left").select(*[F.col(f"`{c}`") for c in df.columns], F.col(MAP))
    done = restored_by_map(joined, pattern, name, key, text_col)
    return done.unionByName(untouched(df.where(~has_token), text_col))
