"""Transit schedules: next departure, service-day bits, stop pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = 3600  #: seconds of a join slot


def next_departure(asked: DataFrame, departures: DataFrame) -> DataFrame:
    """The earliest departure of the asked line at or after the asked second that runs on the asked weekday.

    Requests and departures are merged in one ordered pass per line and weekday, latest first: each request takes the
    departure that the pass met last. Ties go to the smaller trip. Requests without a departure left that day have no
    row.
    """
    days = departures.select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("dow")).where("(shiftright(dow_mask, dow) & 1) = 1")
    firsts = days.groupBy("line_id", "dow", "dep_secs").agg(F.min(F.struct("trip_id", "line_no")).alias("d")).select("line_id", "dow", F.col("dep_secs").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("req_id"), F.struct(F.col("dep_secs"), F.col("d.trip_id").alias("trip_id")).alias("dep"))
    asks = asked.select("line_id", "dow", F.col("t_secs").alias("at"), F.lit(0).alias("kind"), "req_id", F.lit(None).cast("struct<dep_secs:bigint,trip_id:bigint>").alias("dep"))
    # a frame that ends at the current row grows by one; one that begins there would be summed anew for each row
    met = Window.partitionBy("line_id", "dow").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    merged = firsts.unionByName(asks).withColumn("next", F.last("dep", ignorenulls=True).over(met))
    return merged.where("kind = 0 AND next IS NOT NULL").select("req_id", "line_id", F.col("at").alias("t_secs"), "next.dep_secs", "next.trip_id")


def service_bits(week: str, first_dow: str, begin: str, end: str, days: int = 60) -> Column:
    """Bits of the days in [begin, end] whose weekday is in the week mask."""
    day = f"CASE WHEN d >= {begin} AND d <= {end} AND (shiftright({week}, CAST(({first_dow} + d) % 7 AS INT)) & 1) = 1 THEN shiftleft(1L, d) ELSE 0L END"
    return F.expr(f"aggregate(sequence(0, {days - 1}), 0L, (s, d) -> s | {day})")


def stop_pairs(stop_times: DataFrame) -> DataFrame:
    """Consecutive stops of each trip by stop_sequence."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    pairs = stop_times.select("trip_id", F.col("stop_id").alias("from_stop"), F.lead("stop_id").over(w).alias("to_stop"), "departure", F.lead("arrival").over(w).alias("arrival"))
    return pairs.where("to_stop IS NOT NULL")
