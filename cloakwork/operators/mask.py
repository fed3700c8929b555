"""Replacing secrets in text.

A text without findings is returned as it is.  Otherwise each line with findings is cut into segments at
the findings' offsets; the other literal occurrences of the same values in that line are then looked for
in the plain segments only, so a value is never searched inside a token that was just put in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let, walk
from ..functions.crypto import seal
from ..functions.text import join_lines, quote_literal
from ..functions.tokens import inline_token, mask_token, vault_id, vault_token
from .catalogue import Rule
from .detect import finding_list, scan_with

if TYPE_CHECKING:
    from .rule_index import RuleIndex

MODES = ("category", "number", "inline", "vault")

_SEGMENTS = "array<struct<t:string,k:int>>"


def _segment(text: Column, k: Column) -> Column:
    return F.struct(text.alias("t"), k.cast("int").alias("k"))


def _cut(unit: Column, found: Column) -> Column:
    """Segments of a line: plain text (k = -1) and findings in turn.

    k is the number of the finding in the line, or of the first one with the same value.
    """

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        f = x["f"]
        plain = F.substring(unit, at + 1, f["s"] - at)
        return f["e"], F.array(_segment(plain, F.lit(-1)), _segment(f["value"], x["k"]))

    def finish(state: Column) -> Column:
        rest = F.substring(unit, state["carry"] + 1, F.length(unit))
        return F.concat(state["out"], F.array(_segment(rest, F.lit(-1))))

    def counted(values: Column) -> Column:
        return F.transform(
            found, lambda f: F.struct(f.alias("f"), (F.array_position(values, f["value"]) - 1).alias("k"))
        )

    values = F.transform(found, lambda f: f["value"])
    numbered = let(values, counted)
    return let(let(numbered, lambda items: walk(items, F.lit(0), _SEGMENTS, step)), finish)


def _cut_repeats(segments: Column, found: Column) -> Column:
    """Cut the plain segments further at literal repeats of the values, longest value first."""
    values = F.array_sort(
        F.transform(
            found,
            lambda f, k: F.struct(
                (-F.length(f["value"])).alias("order"), k.alias("k"), f["value"].alias("v")
            ),
        )
    )

    def pieces(segment: Column, x: Column) -> Column:
        def piece(text: Column, j: Column) -> Column:
            plain = _segment(text, F.lit(-1))
            return F.when(j == 0, F.array(plain)).otherwise(F.array(_segment(x["v"], x["k"]), plain))

        return F.flatten(F.transform(F.split(segment["t"], quote_literal(x["v"]), -1), piece))

    def step(state: Column, x: Column) -> Column:
        def one(segment: Column) -> Column:
            repeats = (segment["k"] == -1) & F.contains(segment["t"], x["v"])
            return F.when(repeats, pieces(segment, x)).otherwise(F.array(segment))

        return F.flatten(F.transform(state, one))

    def cut(x: Column) -> Column:
        # Few values come back in the rest of the line, so only those are looked for piece by piece.
        again = F.filter(values, lambda v: F.contains(x["plain"], v["v"]))
        return F.aggregate(again, x["segments"], step)

    plain = F.transform(segments, lambda y: F.when(y["k"] == -1, y["t"]).otherwise(F.lit("")))
    return let(
        F.struct(segments.alias("segments"), F.array_join(plain, "\n").alias("plain")), cut
    )


def _masked_unit(x: Column, token: Callable[[Column, Column], Column]) -> Column:
    segments = let(_cut(x["text"], x["found"]), lambda cut: _cut_repeats(cut, x["found"]))
    shown = F.transform(
        segments,
        lambda segment: F.when(segment["k"] == -1, segment["t"]).otherwise(
            token(F.get(x["found"], segment["k"]), segment["k"])
        ),
    )
    return F.when(F.size(x["found"]) == 0, x["text"]).otherwise(F.array_join(shown, ""))


def masked_text(
    text: Column, scan: Column, token: Callable[[Column, Column, Column], Column]
) -> Column:
    """The text with ``token(finding, unit number, number within the unit)`` in place of each finding."""

    def unit(x: Column, i: Column) -> Column:
        return _masked_unit(x, lambda f, k: token(f, i, k))

    found = F.exists(scan, lambda x: F.size(x["found"]) > 0)
    return F.when(found, join_lines(F.transform(scan, unit), text)).otherwise(text)


def _found_before(scan: Column) -> Column:
    """For each unit, how many findings the units before it have.

    One mark per unit followed by one per finding: a unit's mark stands at its own number plus the findings
    before it, so all counts come from one walk.
    """
    marks = F.flatten(
        F.transform(
            scan, lambda x: F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), F.size(x["found"])))
        )
    )
    places = F.array_compact(F.transform(marks, lambda unit, at: F.when(unit, at)))
    return F.transform(places, lambda at, i: at - i)


def _place(ids: Sequence[Column], *numbers: Column) -> Column:
    return F.concat_ws("\u0002", *[c.cast("string") for c in (*ids, *numbers)])


def protect(
    df: DataFrame,
    text_col: str = "text",
    *,
    mode: str = "category",
    id_cols: Sequence[str] = ("doc_id",),
    key: bytes | None = None,
    corpus: str | None = None,
    custom: Sequence[Rule] = (),
    scope: str = "document",
    entropy: bool = False,
    rules: RuleIndex | None = None,
    numbered_after: str | None = None,
) -> DataFrame:
    """Mask a text column in one pass.

    ``rules`` is a table of custom rules of any size, see ``rule_index``; ``numbered_after`` a column with the number
    of findings before the text, where it is a part of one.

    Adds ``masked_text``, ``n_findings``, ``secret_lines`` (units with a finding) and ``vault``: the rows
    needed to restore the text later (``number`` and ``vault`` mode with a key; empty otherwise).

    * ``category``: ``[REDACTED_<category>]``; restorable from a backup only.
    * ``number``: ``[REDACTED_<n>]``, n counting the findings of the document from 1.
    * ``inline``: the sealed value itself behind a fixed prefix; needs a key.
    * ``vault``: a reference token with an id derived from key, ``corpus``, place and value; the sealed value is in
      the vault only.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    if mode == "inline" and key is None:
        raise ValueError("inline mode needs a key")
    if mode == "vault" and not corpus:
        raise ValueError("vault mode needs the name of the corpus: ids of two corpora must not meet in one vault")
    keep = [F.col(f"`{c}`") for c in df.columns]
    ids = [F.col(f"`{c}`") for c in id_cols]

    past = F.col(numbered_after) if numbered_after else F.lit(0)
    # Only a digest of the key goes into the plan; with it, ids of equal texts differ between keys.
    seed = hashlib.sha256(b"vault id" + (key or b"")).hexdigest()

    def reference(f: Column, n: Column) -> Column:
        return vault_id(seed, F.lit(corpus), _place(ids, n), f["value"])

    def token(before: Column) -> Callable[[Column, Column, Column], Column]:
        def spell(f: Column, i: Column, k: Column) -> Column:
            if mode == "category":
                return mask_token(f["category"])
            if mode == "inline":
                return inline_token(seal(f["value"], key, _place(ids, i, k)))
            ordinal = F.get(before, i) + k + 1 + past
            return mask_token(ordinal.cast("string")) if mode == "number" else vault_token(reference(f, ordinal))

        return spell

    def vault_row(f: Column) -> Column:
        n = f["ordinal"] + past
        return F.struct(
            (reference(f, n) if mode == "vault" else n.cast("string")).alias("token_id"),
            seal(f["value"], key, _place(ids, n)).alias("payload"),
            f["category"].alias("category"),
        )

    def vault(scan: Column) -> Column:
        if key is None or mode not in ("number", "vault"):
            return F.array().cast("array<struct<token_id:string,payload:string,category:string>>")
        return F.transform(finding_list(scan), vault_row)

    text = F.col(text_col)

    def result(scan: Column, before: Column) -> Column:
        sizes = F.transform(scan, lambda x: F.size(x["found"]))
        total = F.aggregate(sizes, F.lit(0), lambda n, size: n + size)
        return F.struct(
            masked_text(text, scan, token(before)).alias("masked_text"),
            F.coalesce(total, F.lit(0)).alias("n_findings"),
            F.coalesce(F.size(F.filter(sizes, lambda size: size > 0)), F.lit(0)).alias("secret_lines"),
            vault(scan).alias("vault"),
        )

    def whole(scan: Column) -> Column:
        if mode in ("category", "inline"):
            return result(scan, F.lit(None))
        return let(_found_before(scan), lambda before: result(scan, before))

    rows, scan = scan_with(df, text_col, custom, rules, scope, entropy)
    done = let(scan, whole)
    return rows.select(*keep, done.alias("__cw")).select(*keep, "__cw.*")


def mask(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``protect`` without the vault column."""
    return protect(df, text_col, **options).drop("vault")


def redact(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Redacted text and how many replacements it took."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    masked = protect(df, text_col, **options)
    return masked.select(
        *keep, F.col("masked_text").alias("redacted_text"), F.col("n_findings").alias("replacements")
    )


def vault_of(protected: DataFrame, id_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The vault as a table, one row per token."""
    ids = [F.col(f"`{c}`") for c in id_cols]
    rows = protected.select(*ids, F.explode_outer("vault").alias("v")).where(F.col("v").isNotNull())
    return rows.select(*ids, "v.token_id", "v.payload", "v.category")
