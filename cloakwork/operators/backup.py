"""Keeping the original of every masked text, and putting it back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import Rule
from .detect import found_in


def backup(
    df: DataFrame,
    text_col: str = "text",
    *,
    id_cols: Sequence[str] = ("doc_id",),
    only_masked: bool = True,
    custom: Sequence[Rule] = (),
    scope: str = "document",
) -> DataFrame:
    """Originals to keep: those with findings, or all of them."""
    ids = [F.col(f"`{c}`") for c in id_cols]
    wanted = df.select(*ids, F.col(text_col).alias("text"))
    if not only_masked:
        return wanted
    found = found_in("text", custom, scope)
    return wanted.where(F.size(found) > 0)


def restore(
    wanted: DataFrame, store: DataFrame, id_cols: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The kept original of each wanted document, null where there is none."""
    ids = list(id_cols)
    originals = store.select(*ids, F.col("text").alias("original_text"))
    return wanted.join(originals, ids, "left")


def forget(store: DataFrame, restored: DataFrame, id_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """What remains in the store once the restored documents are cleared from it."""
    return store.join(restored.select(*id_cols), list(id_cols), "left_anti")
