"""One stream that feeds all stored tables and analytics: each source is read once a batch.

Every batch is kept while it is written: first the raw rows of each source, each once (see
:mod:`skylane.streaming.ledger`), then the hours that they touch. An analysis is worked out anew for the hours that were
touched since its own last batch, from the stored rows of these hours, and its rows replace those of the same window. So
late rows count whenever they come, no state grows, and an analysis that fails holds up nothing else: it stays behind and
catches up with the next batch.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skylane.operators import analytics
from skylane.operators.windows import combined_windows, flat
from skylane.streaming import sinks
from skylane.streaming.ledger import BATCH, Ledger, query_of

_log = logging.getLogger(__name__)

#: Stored sources and the columns of their times.
SOURCES = {"bike_trips": "start_time_ts", "taxi_trips": "datetime_ts", "weather_data": "datetime_ts", "accidents": "dispatch_timestamp"}
_HOUR = "touched_hour"


@dataclass(frozen=True)
class Analysis:
    """``build`` makes the rows from tables by name (``combined`` among them); ``keys`` name a row. Without keys, rows follow from a batch's own rows."""

    build: Callable[[dict[str, DataFrame]], DataFrame]
    keys: tuple[str, ...] = ("window_start",)


def _over_combined(f: Callable[[DataFrame], DataFrame]) -> Analysis:
    return Analysis(lambda t: f(flat(t["combined"])))


ANALYSES = {
    "weather_transport_correlation": _over_combined(analytics.weather_transport),
    "weather_safety_analysis": Analysis(lambda t: analytics.safety_risk(t["accidents"], t["weather_data"]), ("window_start", "mode_type")),
    "surge_weather_correlation": Analysis(lambda t: analytics.surge_reasons(t["taxi_trips"]), ()),
    "transport_usage_summary": Analysis(lambda t: analytics.usage_summary(t["bike_trips"], t["taxi_trips"])),
    "pearson_correlations": _over_combined(analytics.correlation_products),
    "weather_binned_metrics": _over_combined(analytics.weather_bins),
    "precipitation_impact": _over_combined(analytics.precipitation_impact),
    "temporal_correlations": _over_combined(analytics.temporal_segments),
    "multi_variable_summary": _over_combined(analytics.multi_variable),
    "accident_weather_correlation": Analysis(lambda t: analytics.accident_weather(t["combined"], t["accidents"]), ("window_start", "mode_type")),
}


def result(spark, root: str, name: str) -> DataFrame | None:
    """A stored source or the present rows of an analysis; None before its first batch."""
    ledger, keys = Ledger(spark, f"{root}/{name}"), ANALYSES[name].keys if name in ANALYSES else ()
    rows = ledger.latest(list(keys)) if keys else ledger.read()
    return rows if rows is None or keys else rows.drop(BATCH)


def _hour(ts: str):
    return F.date_trunc("hour", F.col(ts).cast("timestamp"))


class _Batch:
    """What one batch writes."""

    def __init__(self, root: str, enabled: dict[str, bool] | None, tie: str | None, rows_per_file: int):
        self.root, self.enabled, self.tie, self.rows_per_file = root, enabled or {}, tie, rows_per_file

    def _ledger(self, name: str) -> Ledger:
        return Ledger(self.spark, f"{self.root}/{name}", self.rows_per_file)

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.spark, self.number, self.new = batch.sparkSession, number, batch.persist()
        self.tables: dict[int, dict[str, DataFrame]] = {}
        try:
            if any(r.query != query_of(self.spark) for r in self._ledger("touched_hours").records()):
                raise ValueError(f"{self.root} was written by a stream with another checkpoint")
            for name in SOURCES:
                self._ledger(name).add(self._rows(name), number)
            hours = reduce(DataFrame.union, [self._rows(name).select(_hour(ts).alias(_HOUR)) for name, ts in SOURCES.items()])
            self._ledger("touched_hours").add(hours.where(F.col(_HOUR).isNotNull()).distinct(), number)
            failed = [name for name in ANALYSES if self.enabled.get(name, True) and not self._add(name)]
            if failed:
                _log.warning("batch %d: behind are %s", number, ", ".join(failed))
        finally:
            for tables in self.tables.values():
                tables["combined"].unpersist()
            self.new.unpersist()

    def _rows(self, name: str) -> DataFrame:
        return self.new.where(F.col("source") == name).select(f"{name}.*")

    def _add(self, name: str) -> bool:
        """Bring an analysis up to this batch; whether that worked."""
        analysis, ledger = ANALYSES[name], self._ledger(name)
        try:
            done = max((r.last for r in ledger.records()), default=-1)
            if done >= self.number:
                return True
            if analysis.keys:
                rows = analysis.build(self._since(done))
            else:
                stored = self._ledger("taxi_trips").read().where(F.col(BATCH) > done).drop(BATCH) if done < self.number - 1 else self._rows("taxi_trips")
                rows = analysis.build({"taxi_trips": stored})
            ledger.add(rows, self.number)
        except Exception:
            _log.exception("%s failed in batch %d", name, self.number)
            return False
        return True

    def _since(self, done: int) -> dict[str, DataFrame]:
        """Stored rows of all hours that batches after ``done`` touched; analyses that are equally far share them."""
        if done not in self.tables:
            hours = self._ledger("touched_hours").read().where(F.col(BATCH) > done).select(_HOUR).distinct()
            ends = hours.agg(F.min(_HOUR).alias("low"), F.max(_HOUR).alias("high")).first()
            tables = {}
            for name, ts in SOURCES.items():
                rows = self._ledger(name).read().drop(BATCH)
                within = rows.where((F.col(ts) >= F.lit(ends.low)) & (F.col(ts) < F.lit(ends.high) + F.expr("INTERVAL 1 HOUR")))  # reaches the scan
                tables[name] = within.join(F.broadcast(hours), _hour(ts) == F.col(_HOUR), "left_semi")  # a row for each hour of the data at most
            combined = combined_windows(tables["bike_trips"], tables["taxi_trips"], tables["weather_data"], tie=self.tie)
            self.tables[done] = {**tables, "combined": combined.persist()}
        return self.tables[done]


def start_fanout(
    streams: dict[str, DataFrame], root: str, checkpoint: str, name: str = "fanout", enabled: dict[str, bool] | None = None, tie: str | None = None,
    trigger: str | None = sinks.ANALYTICS_TRIGGER, rows_per_file: int = 1_000_000,
) -> StreamingQuery:
    """Start the stream of all :data:`SOURCES` (parsed; watermarks are not needed) into stored tables and analytics below ``root``.

    A root belongs to one checkpoint. ``enabled`` switches analyses off; ``tie`` orders observations of one time. :func:`result` reads what is there.
    """
    tagged = [frame.select(F.lit(source).alias("source"), F.struct("*").alias(source)) for source, frame in streams.items()]
    if set(streams) != set(SOURCES):
        raise ValueError(f"streams of {', '.join(SOURCES)} are needed")
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    writer = everything.writeStream.foreachBatch(_Batch(root, enabled, tie, rows_per_file)).queryName(name).option("checkpointLocation", checkpoint)
    return sinks._start(writer, trigger)
