"""Joins of trips and weather by time.

Spark has no range join, so both sides get time buckets a quarter of the tolerance wide: the left row goes to its own
bucket, the right row to each that its interval touches, and an equi join on the bucket leaves a short residual check, one
of nine or ten that fails. A left row stands in one bucket, so a left join is a plain one; a left row meets a right row
once. Pairs are neither shuffled nor held: what is moved grows with the rows of both sides, only the result with the pairs.
A crowded bucket is cut on both sides into parts, so a moment at which most rows stand is neither held nor joined by one task; blocks
of few rows meet there, in an order that lets files of the pairs shrink. The nearest right row needs no pairs: both sides are sorted
together in slices of time, and each row sees its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylane.operators.stream_joins import interval_on_streams, nearest_on_streams


#: Buckets of a tolerance. More of them leave fewer pairs to check in vain; a right row stands in twice as many and one or two more.
BUCKETS = 4

#: Rows of a side that a task joins at once: a bucket with more is cut into parts, and two parts that meet are a key of their own.
CROWD = 10_000

#: Rows of a part, left and right, that stand in one row of such a join. All pairs of a right block with a part of the left wait
#: in memory at once; a left block comes again for each row of the right block, and so often at least does a file of pairs repeat itself.
BLOCKS = 256, 8


def _bucket(micros, width: int):
    return F.floor(micros / width).cast("long")


def _dealt_out(columns: list[str]):
    """A bucket far from all times for rows without one, which match nothing."""
    return -1_000_000_000_000_000 - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(4096))


def micros(column: str):
    """Microseconds of a timestamp with or without a zone (UTC sessions make both alike)."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def within_interval(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, seconds: int, how: str = "inner") -> DataFrame:
    """All pairs whose times differ by at most ``seconds`` (both ends count). Column names of the sides must differ.

    ``how='left'`` keeps left rows without a match. Rows with a null time match nothing. Streams need watermarks on both
    sides and give a row once its reach has passed (see :mod:`skylane.operators.stream_joins`). Batch frames are counted
    by bucket first, which is a job of its own.
    """
    if left.isStreaming or right.isStreaming:
        return interval_on_streams(left, right, left_ts, right_ts, seconds, how)
    width = seconds * 1_000_000
    step = max(1, width // BUCKETS)
    probe = left.withColumn("__at", micros(left_ts)).withColumn("__b", F.coalesce(_bucket(F.col("__at"), step), _dealt_out(left.columns)))
    build = right.withColumn("__rt", micros(right_ts)).where("__rt is not null")
    crowds = _crowds(probe, build, width, step)
    build = build.withColumn("__rb", F.explode(F.sequence(_bucket(F.col("__rt") - width, step), _bucket(F.col("__rt") + width, step))))
    near = (F.col("__b") == F.col("__rb")) & (F.abs(F.col("__rt") - F.col("__at")) <= width)
    if crowds.isEmpty():
        # Sorted and merged: a broadcast would hold all copies at once, and estimates know neither the copies nor the pairs.
        return probe.join(build.hint("merge"), near, how).drop("__at", "__b", "__rt", "__rb")
    # A left row stands in one of its parts and meets each part of the right, and the other way about: a pair meets once.
    probe = _in_parts(probe, crowds, "__b", left.columns, own="__lefts", other="__rights").withColumnsRenamed({"__own": "__i", "__other": "__j"})
    build = _in_parts(build, crowds, "__rb", right.columns, own="__rights", other="__lefts").withColumnsRenamed({"__own": "__rj", "__other": "__ri"})
    # A number of partitions of one's own keeps parts of few bytes and many pairs from being merged into one task.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Times in microseconds are worked out anew behind the exchange rather than moved beside the columns they come from.
    probe = probe.drop("__at").repartition(tasks, "__b", "__i", "__j").withColumn("__at", micros(left_ts))
    build = build.drop("__rt").repartition(tasks, "__rb", "__ri", "__rj").withColumn("__rt", micros(right_ts))
    probe = _in_blocks(probe, ["__b", "__i", "__j"], left.columns, "__at", BLOCKS[0]).withColumnsRenamed({"__block": "__ls", "__first": "__l0", "__last": "__l1"})
    build = _in_blocks(build, ["__rb", "__ri", "__rj"], right.columns, "__rt", BLOCKS[1]).withColumnsRenamed({"__block": "__rs", "__first": "__r0", "__last": "__r1"})
    same = (F.col("__b") == F.col("__rb")) & (F.col("__i") == F.col("__ri")) & (F.col("__j") == F.col("__rj"))
    met = build.join(probe.hint("merge"), same & (F.col("__l0") <= F.col("__r1") + width) & (F.col("__l1") >= F.col("__r0") - width))
    met = met.select("__ls", F.explode("__rs").alias("__r")).select("__r", F.explode("__ls").alias("__l")).where(F.abs(F.col("__r.at") - F.col("__l.at")) <= width)
    met = met.select(*[F.col(f"__l.row.`{c}`").alias(c) for c in left.columns], *[F.col(f"__r.row.`{c}`").alias(c) for c in right.columns])
    if how == "inner":
        return met
    # What meets nothing can't be told within a part; its neighbours in time tell.
    around = neighbours_in_time(left, right.select(right_ts), left_ts, right_ts, None, seconds).where("__before is null and __after is null")
    return met.unionByName(around.select("__l.*"), allowMissingColumns=True)


def _named(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]


def _in_blocks(rows: DataFrame, keys: list[str], columns: list[str], at: str, size: int) -> DataFrame:
    """Rows of each key in lists ``__block`` of at most ``size`` in order of time, with their ``__first`` and ``__last`` time. Rows without a time are left out."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    rows = rows.where(F.col(at).isNotNull()).withColumn("__k", F.floor((place - 1) / size))
    block = F.collect_list(F.struct(F.col(at).alias("at"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")))
    return rows.groupBy(*keys, "__k").agg(block.alias("__block"), F.min(at).alias("__first"), F.max(at).alias("__last")).drop("__k")


def _crowds(probe: DataFrame, build: DataFrame, width: int, step: int) -> DataFrame:
    """Buckets ``__crowd`` with more than ``CROWD`` rows of a side, and the parts ``__lefts`` and ``__rights`` that hold about as many each."""
    reach = -(-width // step)
    held = probe.where("__at is not null").groupBy(F.col("__b").alias("__crowd")).agg(F.count("*").alias("__lefts"))
    met = build.groupBy(_bucket(F.col("__rt"), step).alias("__from")).agg(F.count("*").alias("__n"))
    met = met.select("__n", F.explode(F.sequence(F.col("__from") - reach, F.col("__from") + reach)).alias("__crowd"))
    both = held.join(met.groupBy("__crowd").agg(F.sum("__n").alias("__rights")), "__crowd")
    return both.where(F.greatest("__lefts", "__rights") > CROWD).select("__crowd", *[F.ceil(F.col(c) / CROWD).alias(c) for c in ("__lefts", "__rights")])


def _in_parts(rows: DataFrame, crowds: DataFrame, bucket: str, columns: list[str], own: str, other: str) -> DataFrame:
    """Each row with its part ``__own`` by hash, once for each part ``__other`` of the other side; one part where no crowd is."""
    # A crowd stands for thousands of rows, so the table of them is small.
    placed = rows.join(F.broadcast(crowds), F.col(bucket) == F.col("__crowd"), "left")
    parts = lambda c: F.coalesce(F.col(c), F.lit(1).cast("long"))
    placed = placed.withColumn("__own", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), parts(own)))
    return placed.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), parts(other) - 1))).drop("__crowd", own, other)


def nearest_in_time(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, right_id: str | None = None, seconds: int = 3600, how: str = "inner") -> DataFrame:
    """For each left row the right row nearest in time within ``seconds``.

    Ties go to the earlier right row, then to the smaller ``right_id`` (without one: the row that is smaller column by
    column). ``how='left'`` keeps left rows without a match. Returns the left columns, the right columns and ``time_diff`` in seconds. Rows with a null time match nothing.

    A row comes out for each left row, repeated rows included. Batch frames are joined as of both neighbours in time;
    streams, which need watermarks on both times, answer a row when the watermark has passed its reach.
    """
    if left.isStreaming or right.isStreaming:
        return nearest_on_streams(left, right, left_ts, right_ts, right_id, seconds, how)
    both = neighbours_in_time(left, right, left_ts, right_ts, right_id, seconds)
    at, before, after = F.col("__t"), F.col("__before"), F.col("__after")
    gaps = both.select("__l", at - before["t"], after["t"] - at, before["r"], after["r"]).toDF("__l", "gb", "ga", "rb", "ra")
    first = F.col("gb").isNotNull() & (F.col("ga").isNull() | (F.col("gb") <= F.col("ga")))
    best = gaps.select("__l", F.when(first, F.col("rb")).otherwise(F.col("ra")).alias("r"), F.when(first, F.col("gb")).otherwise(F.col("ga")).alias("gap"))
    best = best if how == "left" else best.where("gap is not null")
    return best.select(*[F.col(f"__l.`{c}`").alias(c) for c in left.columns], *[F.col(f"r.`{c}`").alias(c) for c in right.columns], (F.col("gap") / 1_000_000).alias("time_diff"))


def _least_row(right: DataFrame, right_id: str | None):
    return F.min(F.struct("*")) if right_id is None else F.min_by(F.struct("*"), right_id)


#: Slices of the tolerance in which rows are sorted: a slice is a window partition, so a crowded hour is dealt out.
SLICES = 60


def neighbours_in_time(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, right_id: str | None, seconds: int) -> DataFrame:
    """Each left row ``__l`` with its time ``__t`` in microseconds and the right rows just ``__before`` (or at) and ``__after`` it.

    Both are ``(t, r)`` with the right row ``r`` (of equal times the one with the smallest ``right_id``), or null if none is
    within ``seconds``. Both sides are sorted once in slices of time; what stands before a slice's first and after its last
    right row comes from the slices around it, of which each gives one row. So the work grows with the rows of both sides.
    """
    width = seconds * 1_000_000
    slice_ = max(1, width // SLICES)
    reach = -(-width // slice_)  # slices on either side that the tolerance can touch
    near = right.where(F.col(right_ts).isNotNull()).groupBy(micros(right_ts).alias("t")).agg(_least_row(right, right_id).alias("r"))
    near = near.select("t", F.struct("t", "r").alias("r"))
    kinds = left.select(F.struct("*").alias("l")).schema["l"].dataType
    rows = left.select(micros(left_ts).alias("t"), F.struct("*").alias("l"), F.lit(None).cast(near.schema["r"].dataType).alias("r"), F.lit(1).alias("side"))
    rows = rows.unionByName(near.select("t", F.lit(None).cast(kinds).alias("l"), "r", F.lit(0).alias("side")))
    # Rows without a time match nothing and are dealt out by hash.
    rows = rows.withColumn("s", F.coalesce(F.floor(F.col("t") / slice_), -1_000_000_000_000_000 - F.pmod(F.xxhash64("l"), F.lit(4096))))
    # A slice's own first and last right row, then those of the slices around it, within groups of neighbouring slices.
    ends = rows.where("t is not null").groupBy("s").agg(F.min_by("r", F.when(F.col("side") == 0, F.col("t"))).alias("first"), F.max_by("r", F.when(F.col("side") == 0, F.col("t"))).alias("last"))
    group = F.floor(F.col("s") / reach)
    spread = ends.withColumn("own", group).withColumn("g", F.explode(F.array(group - 1, group, group + 1)))
    by_group = Window.partitionBy("g").orderBy("s")
    around = spread.select(
        "own", "g", F.col("s").alias("of"), F.last("last", ignorenulls=True).over(by_group.rangeBetween(-reach, -1)).alias("earlier"),
        F.first("first", ignorenulls=True).over(by_group.rangeBetween(1, reach)).alias("later"),
    ).where("own = g")
    up, down = Window.partitionBy("s").orderBy("t", "side"), Window.partitionBy("s").orderBy(F.desc("t"), "side")
    placed = rows.withColumn("b", F.last("r", ignorenulls=True).over(up)).withColumn("a", F.last("r", ignorenulls=True).over(down)).where("side = 1")
    met = placed.join(around, F.col("s") == F.col("of"), "left").select("l", "t", F.coalesce("b", "earlier").alias("b"), F.coalesce("a", "later").alias("a"))
    return met.select(
        F.col("l").alias("__l"), F.col("t").alias("__t"), F.when(F.col("t") - F.col("b.t") <= width, F.col("b")).alias("__before"), F.when(F.col("a.t") - F.col("t") <= width, F.col("a")).alias("__after")
    )


def with_daily_precipitation(trips: DataFrame, weather: DataFrame, trip_ts: str, weather_ts: str, amount: str = "precip_daily_mm") -> DataFrame:
    """Left join of the day's total precipitation: ``precip_date``, ``daily_precip_mm`` and ``has_precipitation``."""
    day = lambda c: F.date_format(F.col(c), "yyyy-MM-dd")
    totals = weather.groupBy(day(weather_ts).alias("precip_date")).agg(F.sum(F.coalesce(amount, F.lit(0.0))).alias("daily_precip_mm"))
    joined = trips.withColumn("__day", day(trip_ts)).join(totals, F.col("__day") == F.col("precip_date"), "left").drop("__day")
    return joined.withColumn("has_precipitation", F.coalesce(F.col("daily_precip_mm") > 0, F.lit(False)))
