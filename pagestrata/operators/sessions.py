"""Activity sessions: runs of visits without a long gap, with provenance and passive media.

A session spans all users' or one user's visits in time order, so ordering needs the visits of a ``by`` key
together; without one, the order is cut into ranges of about as many rows. Either way a session is put together from its buckets,
so that no task holds all rows, nor all of a session that never ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.functions import times
from pagestrata.session import checkpointed

GAP_MS, PASSIVE_RUN, PASSIVE_SECONDS, PASSIVE_PAGE_MS = 30 * 60_000, 5, 5, 3 * 60_000
#: Days where a key tells visits apart, else about so many rows.
BUCKET_MS, BUCKET_ROWS = 24 * 3_600_000, 100_000


def number_runs(visits: DataFrame, by: list[str], time: str = "last_visit", order: str = "id", gap: int = GAP_MS) -> DataFrame:
    """Adds ``run``: the start of the visit's session; a gap of exactly ``gap`` doesn't split.

    Buckets order their own visits; of each bucket only its ends and its last break go on to a
    window over buckets.
    """
    return _bucketed(visits, by, time, order, gap).drop("_b")


def _bucketed(visits: DataFrame, by: list[str], time: str, order: str, gap: int) -> DataFrame:
    """number_runs with ``_b``, a visit's bucket; buckets follow the order."""
    if by:
        rows = visits.withColumn("_b", F.floor(F.col(time) / BUCKET_MS))
    else:  # written once, as ranges are drawn anew in each run
        ranges = visits.repartitionByRange(max(1, -(-visits.count() // BUCKET_ROWS)), time, order)
        rows = checkpointed(visits.sparkSession, ranges.withColumn("_b", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "_b").orderBy(time, order)
    rows = rows.withColumn("_prev", F.lag(time).over(inside))
    rows = rows.withColumn("_head", F.when(F.col("_prev").isNull() | (F.col(time) - F.col("_prev") > gap), F.col(time)))
    rows = rows.withColumn("_own", F.last("_head", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    buckets = rows.groupBy(*by, "_b").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"), F.max("_own").alias("_last"))
    across = Window.partitionBy(*by).orderBy("_b")
    joins = F.col("_lo") - F.lag("_hi").over(across) <= gap
    # A bucket that joins the one before and has no break of its own passes that one's session on.
    buckets = buckets.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    entry = F.when(~F.col("_joins") | (F.col("_last") > F.col("_lo")), F.struct("_joins", F.col("_last").alias("open")))
    buckets = buckets.withColumn("_from", F.last(entry, ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)))
    buckets = buckets.select(*by, "_b", "_lo", F.when(F.col("_joins"), F.col("_from.open")).otherwise(F.col("_lo")).alias("_first"))
    keyed = [*by, "_b"]
    out = rows.join(buckets, keyed)
    return out.withColumn("run", F.when(F.col("_own") == F.col("_lo"), F.col("_first")).otherwise(F.col("_own"))).drop("_prev", "_head", "_own", "_lo", "_first")


def passive(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, passive): null without a captured page, false below five, true if the longest idle streak on one domain has five and half the run.

    Streaks are told in the buckets ``_b`` of each run, which know the rows next to their ends; one that begins a bucket goes on with the last of
    the bucket before.
    """
    each = [*keys, "_b"]
    rows = rows.select(*each, "last_visit", "id", "domain", "active_seconds", "captured")
    order, across = Window.partitionBy(*each).orderBy("last_visit", "id"), Window.partitionBy(*keys).orderBy("_b")
    page = F.struct("domain")  # tells a page without a domain from none
    ends = rows.groupBy(*each).agg(F.min("last_visit").alias("_lo"), F.max_by(page, F.struct("last_visit", "id")).alias("_tail"))
    rows = rows.join(ends.select(*each, F.lead("_lo").over(across).alias("_after"), F.lag("_tail").over(across).alias("_before")), each)
    brief = F.coalesce(F.coalesce(F.lead("last_visit").over(order), "_after") - F.col("last_visit") <= PASSIVE_PAGE_MS, F.lit(True))
    same = F.coalesce(F.coalesce(F.lag(page).over(order), "_before")["domain"] == F.col("domain"), F.lit(True))
    rows = rows.withColumn("idle", brief & (F.col("active_seconds") <= PASSIVE_SECONDS)).withColumn("same", same)
    rows = rows.withColumn("island", F.sum(F.when(F.col("idle") & F.col("same"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*each, "island").agg(F.count_if("idle").alias("n"), F.count("*").alias("all"), F.count_if("captured").alias("captured"))
    last = parts.groupBy(*each).agg(F.max("island").alias("island")).withColumn("last", F.when(F.col("island") > 0, F.struct("_b", "island")))
    last = last.select(*each, F.last("last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("last"))
    streak = F.when(F.col("island") > 0, F.struct("_b", "island")).otherwise(F.col("last"))
    streaks = parts.join(last, each).groupBy(*keys, streak.alias("streak")).agg(F.sum("n").alias("n"), F.sum("all").alias("all"), F.sum("captured").alias("captured"))
    return streaks.groupBy(*keys).agg(F.max("n").alias("longest"), F.sum("all").alias("pages"), F.sum("captured").alias("captured")).select(
        *keys, F.when(F.col("captured") == 0, None).when(F.col("pages") < PASSIVE_RUN, False).otherwise((F.col("longest") >= PASSIVE_RUN) & (F.col("longest") * 2 >= F.col("pages"))).alias("passive"))


def build(pages: DataFrame, now: int, by: list[str] | None = None, gap: int = GAP_MS, with_pages: bool = True) -> DataFrame:
    """Sessions of (id, title, domain, first_visit, last_visit, active_seconds, captured), with page ids in time order; without ``with_pages`` no session gathers its pages, and number_runs tells each page's."""
    by = by or []
    rows = _bucketed(pages, by, "last_visit", "id", gap)
    keys = [*by, "run"]
    made = rows.groupBy(*keys).agg(
        F.min("first_visit").alias("start"), F.max("last_visit").alias("end"), F.count("*").alias("page_count"), F.sum("active_seconds").alias("active_seconds"), F.count_if("captured").alias("n_captured"),
        F.min_by("id", F.struct("last_visit", "id")).alias("first_page"), *([F.transform(F.array_sort(F.collect_list(F.struct("last_visit", "id"))), lambda x: x["id"]).alias("page_ids")] if with_pages else []))
    made = made.join(passive(rows, keys), keys)
    provenance = F.when(F.col("n_captured") == F.col("page_count"), "exact").when(F.col("n_captured") == 0, "approximate").otherwise("mixed")
    # The first page's id keeps sessions of one start and size apart.
    name = F.concat(F.lit("s"), F.col("start").cast("string"), F.lit("-"), F.col("page_count").cast("string"), F.lit("-"), F.col("first_page").cast("string"))
    return made.withColumn("provenance", provenance).withColumn("provisional", F.lit(now) - F.col("end") < gap).withColumn("day", times.day_start(F.col("start"))).withColumn("session_id", name).drop("run", "n_captured", "first_page")
