"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it.

    Chained projections would do the same, until a filter above them is pushed down: the optimizer then
    replaces every mention by the whole expression, stage by stage.  A bound value stays one expression.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Items folded at a time, so that a growing result is not copied once per item.
_BLOCK = 64


def walk(
    items: Column,
    carry: Column,
    out_type: str,
    step: Callable[[Column, Column], tuple[Column, Column]],
) -> Column:
    """Go through an array with a carried value, gathering output: ``struct<carry, out>``.

    ``step(carry, item)`` gives the next carry and an array to append to the output.
    """
    empty = F.array().cast(out_type)

    def state(carried: Column, out: Column) -> Column:
        return F.struct(carried.alias("carry"), out.alias("out"))

    def one(s: Column, item: Column) -> Column:
        carried, more = step(s["carry"], item)
        return state(carried, F.concat(s["out"], more))

    def block(s: Column, part: Column) -> Column:
        inner = F.aggregate(part, state(s["carry"], empty), one)
        return let(inner, lambda x: state(x["carry"], F.concat(s["out"], x["out"])))

    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(_BLOCK))
    parts = F.transform(starts, lambda at: F.slice(items, at, _BLOCK))
    return F.aggregate(parts, state(carry, empty), block)
