"""Grouping activity into sessions.

Views within one slot as long as the allowed gap always belong together, so they are first reduced to
one row per visitor and slot (hash aggregation with map-side combine). The window that flags the gaps
then runs over slots, not views: a visitor with a third of all views brings at most one row per slot of
time, so no task has to sort that visitor's views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """``vid, start_ms, end_ms, n_events`` of every session.

    A session ends where the visitor's next view comes more than ``gap_seconds`` later. Rows equal in
    vid, ts, node and path are one view (nulls equal each other). Rows with a null or blank vid or a
    null ts are left out. Views at the same moment are in one session. Empty input gives no row; more
    columns are ignored.
    """
    if gap_seconds <= 0:
        raise ValueError("gap_seconds must be positive")
    gap = gap_seconds * 1_000_000
    known = events.where(F.col("ts").isNotNull() & F.col("vid").rlike(r"[^\s ]"))
    views = known.select("vid", F.unix_micros("ts").alias("at"), "node", "path").distinct()
    slot = F.expr(f"(at - pmod(at, {gap}L)) div {gap}L")
    slots = views.groupBy("vid", slot.alias("slot")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    by_time = Window.partitionBy("vid").orderBy("slot")
    opens = (F.col("first") - F.lag("last").over(by_time) > gap).cast("int")
    numbered = slots.withColumn("opens", F.coalesce(opens, F.lit(1))).withColumn("session", F.sum("opens").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("vid", "session").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n_events"))
    ms = lambda c: F.expr(f"({c} - pmod({c}, 1000L)) div 1000L")
    return merged.select("vid", ms("first").alias("start_ms"), ms("last").alias("end_ms"), "n_events")
