"""Part pruning: key range, key filters, and min/max of any int64 column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from . import keyfilter


@dataclass(frozen=True)
class ColumnRange:
    """Bounds of a column's values, either end open (None), both included."""

    column: str
    low: int | None = None
    high: int | None = None


def stats_exclude(stats: dict | None, ranges: Sequence[ColumnRange]) -> bool:
    """Whether min/max show that no row of the part lies in all ranges; missing statistics never do."""
    for r in ranges:
        s = (stats or {}).get("columns", {}).get(r.column)
        if not s or s.get("min") is None or s.get("max") is None:
            continue
        if (r.low is not None and s["max"] < r.low) or (r.high is not None and s["min"] > r.high):
            return True
    return False


def part_excluded(part, key: int | None, ranges: Sequence[ColumnRange] = ()) -> bool:
    """Whether a part surely has no row of `key` within `ranges`."""
    if key is not None:
        if part.key_min is not None and part.key_max is not None and not part.key_min <= key <= part.key_max:
            return True
        if not keyfilter.bloom_may_hold(part.key_bloom, key) or keyfilter.set_excludes((part.stats or {}).get("keys"), key):
            return True
        spans = (part.stats or {}).get("row_groups")
        if spans and all(len(s) == 2 and s[0] <= s[1] for s in spans) and not any(low <= key <= high for low, high in spans):
            return True
    return stats_exclude(part.stats, ranges)


def bounds(spark: SparkSession, where: str, int_columns: Sequence[str]) -> list[ColumnRange]:
    """Ranges that a predicate implies (see `bounds_of`)."""
    return bounds_of(spark._jsparkSession.sessionState().sqlParser().parseExpression(where), int_columns)


def bounds_of(condition, int_columns: Sequence[str], alias: str | None = None) -> list[ColumnRange]:
    """Ranges from a parsed condition's top-level AND of comparisons of an int64 column with a literal."""
    known: dict[str, list[int | None]] = {}
    todo = [condition]
    names = {f"{alias}.{c}": c for c in int_columns if alias} | {c: c for c in int_columns}
    turned = {"LessThan": "GreaterThan", "LessThanOrEqual": "GreaterThanOrEqual", "GreaterThan": "LessThan", "GreaterThanOrEqual": "LessThanOrEqual"}

    def literal(e) -> int | None:
        return int(e.toString()) if e.getClass().getSimpleName() == "Literal" and e.dataType().simpleString() in ("int", "bigint") else None

    def column(e) -> str | None:
        return names.get(e.name().replace("`", "")) if e.getClass().getSimpleName() == "UnresolvedAttribute" else None

    def put(name: str, low: int | None, high: int | None) -> None:
        at = known.setdefault(name, [None, None])
        at[0] = low if at[0] is None else at[0] if low is None else max(at[0], low)
        at[1] = high if at[1] is None else at[1] if high is None else min(at[1], high)

    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "And":
            todo += [node.left(), node.right()]
        elif kind == "UnresolvedFunction" and node.nameParts().last().lower() in ("and", "between") or kind == "Between":
            parts = [node.children().apply(k) for k in range(node.children().size())]
            if len(parts) == 3 and (name := column(parts[0])) and None not in (ends := (literal(parts[1]), literal(parts[2]))):
                put(name, *ends)
        elif kind in ("EqualTo", *turned):
            a, b = node.left(), node.right()
            if literal(a) is not None:
                a, b, kind = b, a, turned.get(kind, kind)
            if (name := column(a)) and (value := literal(b)) is not None:
                put(name, *{"EqualTo": (value, value), "LessThan": (None, value - 1), "LessThanOrEqual": (None, value), "GreaterThan": (value + 1, None), "GreaterThanOrEqual": (value, None)}[kind])
    return [ColumnRange(c, *v) for c, v in known.items()]
