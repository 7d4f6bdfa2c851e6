"""Rounding and rank helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: half goes up for negatives too, unlike SQL round()."""
    scale = float(10**digits)
    rounded = F.floor(value.cast("double") * F.lit(scale) + F.lit(0.5)).cast("double")
    return rounded / F.lit(scale) if digits else rounded


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def rank_case(value: Column, order: list[str], default: int | None = None) -> Column:
    """Position of an enum value in its ordered list, as a CASE so that it stays in generated code."""
    out = F.lit(len(order) if default is None else default)
    for i in range(len(order) - 1, -1, -1):
        out = F.when(value == order[i], F.lit(i)).otherwise(out)
    return out


def name_of(code: Column, order: list[str]) -> Column:
    """Enum value behind a position from :func:`rank_case`.

    Aggregates carry positions instead of names: a buffer of numbers keeps the aggregation hash-based."""
    return F.get(F.array(*[F.lit(x) for x in order]), code)


def lookup(value: Column, table: dict, default=None) -> Column:
    """Small fixed dictionary as a constant map; a missing key gives the default."""

    def literal(v) -> str:
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else repr(v)

    entries = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in table.items())
    found = F.try_element_at(F.expr(f"map({entries})"), value)
    return found if default is None else F.coalesce(found, F.lit(default))
