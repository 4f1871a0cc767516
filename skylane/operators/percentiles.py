"""Exact discrete percentiles by category, from counts of values.

Equal values are counted first, on the map side. Boundaries cut the distinct values of each category into ``PARTS`` parts of
about the same size; the counts of the parts tell in which one a percentile's rank lies, and only that part is sorted. The
boundaries are estimates, and a second estimate over the same values may differ from the first. So they are used once, where
parts are counted; a part's ends go with its count from there on, and the result is exact wherever they lie. No task takes a
whole category.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the distinct values of a category.
PARTS = 64


def value_counts(rows: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """Rows ``(*by, name, v, n)``: how often each value of each column is there; ``columns`` maps names to columns. Nulls don't count."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("v")) for name, c in columns.items()]))
    return rows.select(*by, each.alias("m")).select(*by, "m.name", "m.v").where("v is not null").groupBy(*by, "name", "v").agg(F.count("*").alias("n"))


def _same(keys: list[str]) -> Column:
    """That the keys of one side equal the other side's, which have a ``_`` before their names; null equals null."""
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))


def _other(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_{k}") for k in keys]


def exact_percentiles(counts: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """A row for each category ``by`` that has values: of ``wanted[alias] = (name, q)`` the smallest value with a share of ``q`` at or below it.

    ``counts`` is what :func:`value_counts` returns, by ``by`` or more columns; it may be a union of several.
    """
    key = [*by, "name"]
    names = sorted({name for name, _ in wanted.values()})
    counts = counts.where(F.col("name").isin(names)).groupBy(*key, "v").agg(F.sum("n").alias("n"))
    cuts = F.percentile_approx("v", [k / PARTS for k in range(1, PARTS)], 10_000)
    found = counts.groupBy(*key).agg(cuts.alias("cuts"), F.sum("n").alias("total")).select(*_other(key), "cuts", "total")
    placed = counts.join(F.broadcast(found), _same(key)).select(*key, "n", "total", "cuts", F.expr("size(filter(cuts, c -> c <= v))").alias("part"))
    ends = [F.expr("get(cuts, part - 1)").alias("low"), F.expr("get(cuts, part)").alias("high")]
    parts = placed.groupBy(*key, "part", *ends).agg(F.sum("n").alias("m"), F.first("total").alias("total"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = F.explode(F.array(*[F.struct(F.lit(alias).alias("alias"), F.lit(name).alias("of"), F.lit(float(q)).alias("q")) for alias, (name, q) in wanted.items()]))
    ranked = parts.withColumn("before", before).select("*", asked.alias("a")).where("a.of = name")
    ranked = ranked.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("a.q") * F.col("total"))) - F.col("before")).where("rank > 0 and rank <= m")
    ranked = ranked.select(*_other(key), "low", "high", "a.alias", "rank")
    within = F.expr("(low is null or low <= v) and (high is null or v < high)")
    inside = counts.join(F.broadcast(ranked), _same(key) & within).select(*key, "v", "n", "alias", "rank")
    up_to = F.sum("n").over(Window.partitionBy(*key, "alias").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hit = inside.withColumn("up_to", up_to).where("up_to >= rank and up_to - n < rank")
    return hit.groupBy(*by).agg(*[F.max(F.when(F.col("alias") == alias, F.col("v"))).alias(alias) for alias in wanted])


def with_percentiles(grouped: DataFrame, percentiles: DataFrame, by: list[str]) -> DataFrame:
    """``grouped``, a row for each category ``by``, with the columns of :func:`exact_percentiles`, null for categories without values."""
    named = percentiles.select(*_other(by), *[c for c in percentiles.columns if c not in by])
    return grouped.join(F.broadcast(named), _same(by), "left").drop(*[f"_{k}" for k in by])
