"""Keyed tables: upserts, merges, deletes, ranges, meta rows, exports.

A stored table is a folder of numbered versions with a list of the complete ones, so a reader always sees a whole
version and a failed writer leaves the last one in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.functions import text, times, urls


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``new`` rows replace ``old`` ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; map-side, so a hot key is one row a task."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*").select(rows.columns)


def merge_captures(pages: DataFrame, queue: DataFrame) -> DataFrame:
    """Drained captures as page rows: known pages keep first_visit, topics and normalized_url, add up visits and seconds, and take the rest anew. cluster_id is left open."""
    old = pages.select("id", *(F.col(c).alias(f"o_{c}") for c in ("normalized_url", "topics", "first_visit", "visit_count", "active_seconds")))
    met = queue.withColumn("u", urls.parts(F.col("url"))).join(old, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return met.select(
        "id", "url", F.coalesce("o_normalized_url", urls.normalize(F.col("u"))).alias("normalized_url"), "title", text.cap(F.col("text")).alias("text"), urls.page_format(F.col("u")).alias("format"),
        F.coalesce("o_topics", F.array().cast("array<string>")).alias("topics"), "extraction_tier", F.coalesce("o_first_visit", "captured_at").alias("first_visit"), F.col("captured_at").alias("last_visit"),
        (zero("o_visit_count") + 1).alias("visit_count"), (zero("o_active_seconds") + F.col("active_seconds")).alias("active_seconds"), F.lit(None).cast("string").alias("cluster_id"))


def delete_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def in_range(pages: DataFrame, start: int, end: int) -> DataFrame:
    """Ids of pages last visited from ``start`` to ``end``, both included; the bounds reach the scan."""
    return pages.where(F.col("last_visit").between(start, end)).select("id")


def delete_range(pages: DataFrame, start: int, end: int) -> DataFrame:
    return pages.where(~F.col("last_visit").between(start, end))


def stamp_clusters(pages: DataFrame, assigned: DataFrame) -> DataFrame:
    """cluster_id of every page replaced; null for pages without one."""
    return pages.drop("cluster_id").join(assigned.select("id", F.col("cluster").cast("string").alias("cluster_id")), "id", "left")


def merge_meta(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Meta rows: fields of ``new`` win where they are set."""
    rest = [c for c in old.columns if c != key]
    met = old.alias("o").join(new.alias("n"), key, "full")
    return met.select(key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest))


def migrate(pages: DataFrame) -> DataFrame:
    """Older tables lack vector_source; their vectors came from titles."""
    return pages.withColumn("vector_source", F.coalesce("vector_source", F.lit("title")) if "vector_source" in pages.columns else F.lit("title"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a stored table, in order."""
    try:
        return sorted(int(r.value.split(" ", 1)[0]) for r in spark.read.text(f"{path}/versions").collect())
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest version, or None."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/v{found[-1]}") if found else None


def written(spark: SparkSession, path: str, token: str) -> bool:
    """Whether a version with this token is listed."""
    return bool(versions(spark, path)) and not spark.read.text(f"{path}/versions").where(F.col("value").endswith(f" {token}")).isEmpty()


def save(spark: SparkSession, frame: DataFrame, path: str, token: str | None = None, keep: int = 3) -> int:
    """Writes a whole new version, lists it, and removes all but the last ``keep``. ``token`` marks what made it, so that a replay can tell (see written)."""
    found = versions(spark, path)
    version = found[-1] + 1 if found else 0
    frame.write.mode("overwrite").parquet(f"{path}/v{version}")
    spark.createDataFrame([(f"{version} {token}" if token else str(version),)], "value string").coalesce(1).write.mode("append").text(f"{path}/versions")
    for old in found[: max(0, len(found) + 1 - keep)]:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return version


def export_rows(pages: DataFrame) -> DataFrame:
    """What an export shows of a page: no vector, quality or ids; times in ISO."""
    return pages.select("url", "title", "text", "format", "topics", times.iso(F.col("first_visit")).alias("firstVisit"), times.iso(F.col("last_visit")).alias("lastVisit"), F.col("visit_count").alias("visitCount"), F.col("active_seconds").alias("activeSeconds"))


def export_json(pages: DataFrame) -> DataFrame:
    """One JSON object a row, newest first."""
    return export_rows(pages.orderBy(F.desc("last_visit"), "id")).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def export_markdown(pages: DataFrame) -> DataFrame:
    """(last_visit, id, day, heading, line): a list line a page, newest first, with a heading where the day changes."""
    seconds = F.col("active_seconds")
    spent = F.when(seconds > 0, F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(seconds / 60 + 0.5).cast("string"), F.lit("m"))))
    meta = F.concat_ws(" · ", "format", F.when(F.col("visit_count") > 1, F.concat(F.col("visit_count").cast("string"), F.lit("×"))), spent)
    title = F.when(F.coalesce("title", F.lit("")) == "", F.col("url")).otherwise(F.col("title"))
    rows = pages.withColumn("day", times.day_start(F.col("last_visit")))
    # The first line of a day is its newest page; ordering stays within days.
    first = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("last_visit"), "id")) == 1
    heading = F.when(first, F.concat(F.lit("## "), F.date_format(times.stamp(F.col("day")), "EEEE, MMMM d, yyyy")))
    line = F.concat(F.lit("- ["), title, F.lit("]("), F.col("url"), F.lit(")"), F.when(meta != "", F.concat(F.lit(" — "), meta)).otherwise(""))
    return rows.select("last_visit", "id", "day", heading.alias("heading"), line.alias("line"))


def health(meta: DataFrame, now: int, stale: int = 3_600_000) -> DataFrame:
    """Adds is_stale and is_orphan: no capture for an hour, and none since the last reload."""
    old = F.coalesce(F.lit(now) - F.col("last_capture_at") > stale, F.lit(True))
    return meta.withColumn("is_stale", old).withColumn("is_orphan", old & F.coalesce(F.col("reloaded_at") > F.coalesce("last_capture_at", F.lit(0)), F.lit(False)))

