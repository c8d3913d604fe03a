"""Whole tables in an order, with each row's place.

A place is a row's number in its range partition and the sizes of the partitions before it: the order costs one range shuffle, and no window
gathers the table in a task. Places start at 0; order by columns that tell rows apart, as equal rows may swap between runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.session import checkpointed

#: Spark's own: the bits below a partition's number in monotonically_increasing_id.
_ROW_BITS = 33


def numbered(frame: DataFrame, *order: Column | str, place: str = "place") -> DataFrame:
    """``frame`` in the order, with ``place``; an empty frame gives an empty one."""
    serial = F.monotonically_increasing_id()
    rows = frame.orderBy(*order).withColumn("_serial", serial)
    # Written once, so that places and partition sizes are of the same ranges.
    rows = checkpointed(frame.sparkSession, rows)
    part = F.shiftright("_serial", _ROW_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("_before"))
    found = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return found.select(*frame.columns, (F.col("_before") + F.col("_serial").bitwiseAND((1 << _ROW_BITS) - 1)).alias(place))


def survivors(pages: DataFrame) -> DataFrame:
    """Pages that the filter kept, newest first, in input order where visited at the same time."""
    return numbered(pages, F.desc("last_visit"), "seq")


def clusters(pages: DataFrame) -> DataFrame:
    """(cluster_id, members, place): clusters by members, the largest first."""
    return numbered(pages.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("members")), F.desc("members"), "cluster_id")


def noise(pages: DataFrame) -> DataFrame:
    """(id, place): pages without a cluster by id."""
    return numbered(pages.where("cluster_id IS NULL").select("id"), "id")


def groups(collapsed: DataFrame) -> DataFrame:
    """(representative, members, place): near-duplicate groups of two pages or more by their representative."""
    found = collapsed.groupBy("group").agg(F.min_by("id", "pos").alias("representative"), F.count("*").alias("members")).where("members > 1")
    return numbered(found.select("representative", "members"), "representative")


def cards(topics: DataFrame) -> DataFrame:
    """Topic cards by the number of their pages, the largest first."""
    return numbered(topics, F.desc("pages"), "cluster_id")


def timeline(sessions: DataFrame) -> DataFrame:
    """Sessions by day, the newest day first, and by start within a day."""
    return numbered(sessions, F.desc("day"), "start", "session_id")
