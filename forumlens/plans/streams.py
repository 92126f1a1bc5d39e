"""Extension: the trailing windows as a stream, run to its end over the stored events."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.streaming import windows

from .registry import Tables, query


@query("ST1_windowed_counts", "select event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, count(*) as n from events group by 1, 2")
def st1(t: Tables):
    counted = windows.run_to_end(t.events, lambda s: windows.windowed_counts(s, "ts", "1 hour", "event_type"), "ts")
    return counted.select("event_type", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n")


@query("ST2_deduplicated_stream", "select count(*) as n, count(distinct event_id) as events from events")
def st2(t: Tables):
    kept = windows.run_to_end(t.events, lambda s: windows.deduplicated(s, "event_id", "ts"), "ts", mode="append")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"))
