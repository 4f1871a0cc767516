"""Labels and points by thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rungs = list[tuple[float, object]]


def below(value: Column, rungs: Rungs, top: object, missing: object | None = None) -> Column:
    """The result of the first rung whose bound lies above ``value``; ``top`` beyond the last. A null value is ``missing`` (or falls to ``top``)."""
    out = F.when(value.isNull(), F.lit(missing)) if missing is not None else None
    for bound, result in rungs:
        hit = value < bound
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return out.otherwise(F.lit(top))


def above(value: Column, rungs: Rungs, rest: object) -> Column:
    """The result of the first rung whose bound lies below ``value``; ``rest`` for all others and for null."""
    out = None
    for bound, result in rungs:
        hit = value > bound
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return out.otherwise(F.lit(rest))


def flag(condition: Column) -> Column:
    """True where the condition holds, false where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False))


def one_if(condition: Column) -> Column:
    return flag(condition).cast("int")


def share(part: Column, whole: Column, scale: float = 1.0, otherwise: object = 0.0) -> Column:
    """``part / whole * scale`` where whole is positive."""
    return F.when(whole > 0, part / whole * F.lit(scale)).otherwise(F.lit(otherwise))
