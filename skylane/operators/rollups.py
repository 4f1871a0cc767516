"""Statistics and panels from small stored cells instead of all trips.

A cell holds what can be merged: counts, means, central moments up to the fourth, least and largest values, and quantile
sketches. Cells of one day and category may stand more than once (one for each batch that brought trips of it), so new
trips add cells and never touch old ones; reading merges them. Cells are as many as days and categories, whatever the
number of trips. Exact percentiles need more: counts of values by category, which add up as well (:func:`statistics_values`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.functions.weather import precipitation_level, temperature_range
from skylane.operators import panels, stats
from skylane.operators.percentiles import exact_percentiles, value_counts, with_percentiles
from skylane.streaming.ledger import Ledger

#: Size of the quantile sketches: exact up to about this many values, off by about 1 / 1,500 of the ranks beyond.
SKETCH = 4096
_SKETCHED = ("speed", "temp", "distance", "duration")


def _moments(name: str) -> list[Column]:
    c = F.col(stats.SHORT[name]).cast("double")
    n = F.count(c)
    m2 = F.coalesce(F.var_pop(c) * n, F.lit(0.0))
    m3 = F.coalesce(F.nanvl(F.skewness(c), F.lit(0.0)) * m2 * F.sqrt(F.try_divide(m2, n)), F.lit(0.0))
    m4 = F.coalesce((F.nanvl(F.kurtosis(c), F.lit(-3.0)) + 3) * F.try_divide(m2 * m2, n), F.lit(0.0))
    sketch = [F.kll_sketch_agg_double(c, F.lit(SKETCH)).alias("sketch")] if name in _SKETCHED else []
    return [F.struct(n.alias("n"), F.avg(c).alias("mean"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"), F.min(c).alias("min"), F.max(c).alias("max"), *sketch).alias(name)]


def _levels() -> dict[str, Column]:
    return {"temp_bucket": temperature_range(F.col("temp_c")), "precip_level": precipitation_level(F.col("precip_daily_mm"))}


def statistics_cells(trips: DataFrame) -> DataFrame:
    """Cells by ``day`` of start, ``weather_condition``, ``temp_bucket`` and ``precip_level``: a struct for each measure, and ``trips``."""
    keys = [F.to_date("starttime").alias("day"), "weather_condition", *[c.alias(name) for name, c in _levels().items()]]
    return trips.groupBy(*keys).agg(F.count("*").alias("trips"), *[c for name in stats.SHORT for c in _moments(name)])


def statistics_values(trips: DataFrame) -> DataFrame:
    """Counts of the values of each measure with percentiles, by the categories of the cells: as many rows as distinct values."""
    return value_counts(trips.withColumns(_levels()), ["weather_condition", "temp_bucket", "precip_level"], {name: stats.SHORT[name] for name in _SKETCHED})


def _measure(name: str, measure: str) -> Column:
    """A statistic of merged cells; as over rows, it is null where there are too few values or no spread."""
    n, m2, m3, m4 = (F.col(f"{name}_{c}") for c in ("n", "m2", "m3", "m4"))
    if measure in stats.PERCENTILES:
        return F.when(n > 0, F.kll_sketch_get_quantile_double(f"{name}_sketch", F.lit(stats.PERCENTILES[measure])))
    variance = F.when(n > 1, m2 / (n - 1))
    spread = F.when(m2 > 0, m2)
    return {
        "mean": F.when(n > 0, F.col(f"{name}_mean")), "variance": variance, "stddev": F.sqrt(variance), "min": F.col(f"{name}_min"), "max": F.col(f"{name}_max"),
        "skewness": F.sqrt(n) * m3 / F.pow(spread, 1.5), "kurtosis": n * m4 / (spread * spread) - 3,
    }[measure]


def _merged(cells: DataFrame, values: DataFrame | None, by: list[str], specs: list[str], trips: str, more: dict[str, tuple[str, str]]) -> DataFrame:
    """Statistics by ``by`` from cells; ``specs`` as in :mod:`skylane.operators.stats`, ``more`` names single ones.

    With the ``values`` of the same trips percentiles are exact, else they come from the sketches.

    Moments are taken about the group's own mean, which comes first: sums of powers about 0 would cancel. The means are a
    row for each category, so they may be broadcast.
    """
    wanted = stats.measures_of(specs) + [(m, name, alias) for alias, (m, name) in more.items()]
    asked = {} if values is None else stats.asked_percentiles(wanted)
    names = sorted({name for _, name, _ in wanted})
    means = cells.groupBy(*by).agg(*[F.try_divide(F.sum(F.col(f"{x}.n") * F.col(f"{x}.mean")), F.sum(F.when(F.col(f"{x}.mean").isNotNull(), F.col(f"{x}.n")))).alias(f"{x}_mean") for x in names])
    near = cells.join(F.broadcast(means), by) if by else cells.crossJoin(F.broadcast(means))
    sums = [F.coalesce(F.sum("trips"), F.lit(0)).alias(trips)]
    for x in names:
        n, m2, m3, d = F.col(f"{x}.n"), F.col(f"{x}.m2"), F.col(f"{x}.m3"), F.col(f"{x}.mean") - F.col(f"{x}_mean")
        sums += [
            F.sum(n).alias(f"{x}_n"), F.first(f"{x}_mean").alias(f"{x}_mean"), F.sum(m2 + n * d * d).alias(f"{x}_m2"), F.sum(m3 + 3 * m2 * d + n * d * d * d).alias(f"{x}_m3"),
            F.sum(F.col(f"{x}.m4") + 4 * m3 * d + 6 * m2 * d * d + n * d * d * d * d).alias(f"{x}_m4"), F.min(f"{x}.min").alias(f"{x}_min"), F.max(f"{x}.max").alias(f"{x}_max"),
        ]
        if x in _SKETCHED and any(name == x and m in stats.PERCENTILES and alias not in asked for m, name, alias in wanted):
            sums.append(F.kll_merge_agg_double(f"{x}.sketch").alias(f"{x}_sketch"))
    merged = near.groupBy(*by).agg(*sums) if by else near.agg(*sums)
    out = merged.select(*by, *[_measure(name, m).alias(alias) for m, name, alias in wanted if alias not in asked], trips)
    if asked:
        out = with_percentiles(out, exact_percentiles(values, by, asked), by)
    return out.select(*by, *[alias for _, _, alias in wanted], trips)


def overall(cells: DataFrame, values: DataFrame | None = None) -> DataFrame:
    return stats.spread(_merged(cells, values, [], stats.OVERALL, "total_trips", {}))


def by_condition(cells: DataFrame, values: DataFrame | None = None) -> DataFrame:
    return stats.spread(_merged(cells, values, ["weather_condition"], stats.BY_CONDITION, "sample_size", {}))


def by_temperature(cells: DataFrame, values: DataFrame | None = None) -> DataFrame:
    return _merged(cells, values, ["temp_bucket"], stats.BY_TEMPERATURE, "sample_size", {"avg_temp_in_bucket": ("mean", "temp")})


def by_precipitation(cells: DataFrame, values: DataFrame | None = None) -> DataFrame:
    return _merged(cells, values, ["precip_level"], stats.BY_PRECIPITATION, "sample_size", {"avg_precip_in_level": ("mean", "precip")})


def add_trips(ledger: Ledger, trips: DataFrame, number: int) -> bool:
    """Add a batch of trips to stored cells, once; reads and writes that batch only. For ``foreachBatch``."""
    return ledger.add(statistics_cells(trips), number)


# -- panels --------------------------------------------------------------------------------------------------------------
_AXES = ("hour_of_day", "precip_level", "temperature", "speed_bucket", "distance_bucket")


def panel_cells(trips: DataFrame, speed_step: int = 2, distance_step: int = 500) -> DataFrame:
    """Cells by day along one axis each (``axis`` names it): counts and sums of the trips that move, of plausible speed, with a distance."""
    speed, distance = F.col("average_speed_kmh"), F.col("distance_meters")
    moving, plausible, far = speed > 0, (speed > 0) & (speed < 50), distance > 0
    placed = trips.select(
        F.to_date("starttime").alias("day"), F.hour("starttime").alias("hour_of_day"), precipitation_level(F.col("precip_daily_mm")).alias("precip_level"), F.round("temp_c", 0).alias("temperature"),
        (F.floor(speed / speed_step) * speed_step).alias("speed_bucket"), (F.floor(distance / distance_step) * distance_step).alias("distance_bucket"),
        "starttime", "stoptime", "tripduration", F.col("precip_daily_mm").alias("precip"), speed.alias("speed"), moving.alias("moving"), plausible.alias("plausible"), far.alias("far"),
    )
    day = F.col("day")
    axes = [F.col(a) for a in _AXES]
    of = lambda condition, value: F.sum(F.when(F.col(condition), F.col(value)))
    axis = F.coalesce(*[F.when(F.grouping(a) == 0, F.lit(a)) for a in _AXES])
    return placed.groupingSets([[day, a] for a in axes], day, *axes).agg(
        axis.alias("axis"), F.count_if("moving").alias("moving"), of("moving", "tripduration").alias("moving_seconds"), F.min(F.when(F.col("moving"), F.col("starttime"))).alias("first_start"),
        F.max(F.when(F.col("moving"), F.col("stoptime"))).alias("last_stop"), F.count_if("plausible").alias("plausible"), of("plausible", "tripduration").alias("plausible_seconds"),
        of("plausible", "speed").alias("speed"), of("plausible", "precip").alias("precip"), F.count_if(F.col("plausible") & F.col("precip").isNotNull()).alias("with_precip"),
        F.count_if("far").alias("far"), of("far", "tripduration").alias("far_seconds"),
    )


def _mean(total: str, n: str, digits: int, name: str, per: int = 1) -> Column:
    return F.round(F.try_divide(F.sum(total), F.sum(n)) / per, digits).alias(name)


def _along(cells: DataFrame, axis: str, counted: str) -> DataFrame:
    return cells.where((F.col("axis") == axis) & (F.col(counted) > 0))


def time_range(cells: DataFrame) -> DataFrame:
    return _along(cells, "hour_of_day", "moving").agg(F.min("first_start").alias("min_time"), F.max("last_stop").alias("max_time"), F.coalesce(F.sum("moving"), F.lit(0)).alias("total_trips"))


def trips_by_hour(cells: DataFrame) -> DataFrame:
    by_hour = _along(cells, "hour_of_day", "moving").groupBy("hour_of_day")
    return by_hour.agg(F.sum("moving").alias("trip_count"), _mean("moving_seconds", "moving", 1, "avg_duration_min", 60)).orderBy("hour_of_day")


def precipitation_panel(cells: DataFrame) -> DataFrame:
    by_level = _along(cells, "precip_level", "plausible").groupBy("precip_level")
    out = by_level.agg(F.sum("plausible").alias("trip_count"), _mean("speed", "plausible", 2, "avg_speed"), _mean("plausible_seconds", "plausible", 1, "avg_duration_min", 60))
    return out.orderBy(panels.rank("precip_level", ["None", "Light", "Moderate", "Heavy"]))


def temperature_and_speed(cells: DataFrame) -> DataFrame:
    by_temperature = _along(cells, "temperature", "plausible").groupBy("temperature")
    return by_temperature.agg(_mean("speed", "plausible", 2, "avg_speed"), F.sum("plausible").alias("trip_count"), _mean("precip", "with_precip", 2, "avg_precip")).orderBy("temperature")


def speed_histogram(cells: DataFrame, most: float = 30) -> DataFrame:
    """``most`` is an end of a bucket."""
    return _along(cells, "speed_bucket", "moving").where(F.col("speed_bucket") < most).groupBy("speed_bucket").agg(F.sum("moving").alias("trip_count")).orderBy("speed_bucket")


def distance_histogram(cells: DataFrame, most: float = 8000) -> DataFrame:
    """``most`` is an end of a bucket."""
    by_distance = _along(cells, "distance_bucket", "far").where(F.col("distance_bucket") < most).groupBy("distance_bucket")
    return by_distance.agg(F.sum("far").alias("trip_count"), _mean("far_seconds", "far", 1, "avg_duration_min", 60)).orderBy("distance_bucket")
