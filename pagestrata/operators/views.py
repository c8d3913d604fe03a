"""Views over pages, clusters, sessions and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.functions import times


def weekly_topics(pages: DataFrame, top: int = 8) -> DataFrame:
    """(week, cluster_id, n): pages a week of the ``top`` labelled clusters (a top-k report), zero where a listed week has none."""
    labelled = pages.where("label IS NOT NULL")
    best = F.broadcast(labelled.groupBy("cluster_id").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "cluster_id").limit(top))
    counts = labelled.join(best, "cluster_id").groupBy(times.week_start(F.col("last_visit")).alias("week"), "cluster_id").agg(F.count("*").alias("n"))
    grid = counts.select("week").distinct().join(best.select("cluster_id"))  # weeks by at most ``top`` clusters
    return grid.join(counts, ["week", "cluster_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def excluded(pages: DataFrame, top: int = 8) -> DataFrame:
    """One row: clustered pages outside the ``top`` labelled clusters, and their share in percent."""
    sizes = pages.where("cluster_id IS NOT NULL").groupBy("cluster_id", F.col("label").isNotNull().alias("named")).agg(F.count("*").alias("n"))
    best = sizes.where("named").orderBy(F.desc("n"), "cluster_id").limit(top).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shown"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("clustered")).join(F.broadcast(best)).select((F.col("clustered") - F.col("shown")).alias("excluded_pages"), F.coalesce(F.try_divide((F.col("clustered") - F.col("shown")) * 100.0, F.col("clustered")), F.lit(0.0)).alias("excluded_pct"))


def topic_cards(pages: DataFrame, buckets: int = 20) -> DataFrame:
    """A row for each cluster with pages: count, last touched, and visits in ``buckets`` even spans."""
    ends = pages.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("pages"), F.min("last_visit").alias("lo"), F.max("last_visit").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), buckets - 1).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col("last_visit") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets)))
    spread = pages.join(ends, "cluster_id").groupBy("cluster_id", at.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return ends.join(spread.groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m")), "cluster_id").select(
        "cluster_id", "pages", F.col("hi").alias("last_touched"), F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("activity"))


def fallback_names(items: DataFrame, by: str, order: list, most: int = 3) -> DataFrame:
    """(by, name): the first titles in an order, joined, with how many more there are."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    sizes = items.groupBy(by).agg(F.count("*").alias("n"))
    first = items.withColumn("_r", rank).where(F.col("_r") <= most).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_r", F.coalesce("title", F.lit("(untitled)")).alias("t")))).alias("t"))
    more = F.when(F.col("n") > most, F.concat(F.lit(" +"), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return first.join(sizes, by).select(by, F.concat(F.array_join(F.transform("t", lambda x: x["t"]), " · "), more).alias("name"))


def facet(pages: DataFrame, by: str, most: int = 40) -> DataFrame:
    """The most frequent values of a column: a top-k report."""
    return pages.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(most)


def top_per(pages: DataFrame, by: str, value: str, most: int) -> DataFrame:
    """(by, value, n, rank): each group's most frequent values."""
    counts = pages.groupBy(by, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


def tiers(pages: DataFrame) -> DataFrame:
    """(extraction_tier, n): captured pages by tier."""
    return pages.where(F.length(F.coalesce("text", F.lit(""))) > 0).groupBy("extraction_tier").agg(F.count("*").alias("n"))


def vector_mix(pages: DataFrame) -> DataFrame:
    """One row: how many vectors come from titles and how many from texts."""
    return pages.agg(F.count_if(F.col("vector_source") == "title").alias("title"), F.count_if(F.col("vector_source") == "text").alias("text"))


def newest(pages: DataFrame, most: int = 100) -> DataFrame:
    """The pages visited last: a top-k report."""
    return pages.orderBy(F.desc("last_visit"), "id").limit(most)


def captured_newest(pages: DataFrame, most: int = 25, preview: int = 320) -> DataFrame:
    """The captured pages visited last, with the beginning of their texts."""
    return newest(pages.where(F.length(F.coalesce("text", F.lit(""))) > 0), most).withColumn("preview", F.substring("text", 1, preview))


def best_resources(pages: DataFrame, most: int = 10) -> DataFrame:
    """Pages visited more than once, the most visited first: a top-k report."""
    return pages.where("visit_count > 1").orderBy(F.desc("visit_count"), "id").limit(most)


def days(sessions: DataFrame) -> DataFrame:
    """(day, earlier, later): the days that have sessions, newest first, each with its neighbours; a row a day."""
    order = Window.orderBy("day")
    return sessions.select("day").distinct().select("day", F.lag("day").over(order).alias("earlier"), F.lead("day").over(order).alias("later")).orderBy(F.desc("day"))


def visit_window(pages: DataFrame) -> DataFrame:
    """One row: the first and the last day of visits."""
    date = lambda c: F.date_format(times.stamp(c), "yyyy-MM-dd")
    return pages.agg(date(F.min("last_visit")).alias("oldest"), date(F.max("last_visit")).alias("newest"))


def largest_groups(groups: DataFrame, pages: DataFrame, most: int = 5) -> DataFrame:
    """(group, n, title): the largest near-duplicate groups of two pages or more, with the representative's title."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"), F.min_by("id", "pos").alias("id")).where("n > 1").orderBy(F.desc("n"), "group").limit(most)
    return sizes.join(pages.select("id", "title"), "id", "left").select("group", "n", "title")


def summary(pages: DataFrame) -> DataFrame:
    """One row of counts: pages, captured, clustered, unclustered, distinct days, and the oldest visit."""
    return pages.agg(
        F.count("*").alias("pages"), F.count_if(F.length(F.coalesce("text", F.lit(""))) > 0).alias("captured"), F.count_if(F.col("cluster_id").isNotNull()).alias("clustered"),
        F.count_if(F.col("cluster_id").isNull()).alias("unclustered"), F.countDistinct(times.day_start(F.col("last_visit"))).alias("days"), F.min(F.when(F.col("last_visit") > 0, F.col("last_visit"))).alias("oldest"))


def day_counts(sessions: DataFrame) -> DataFrame:
    """(day, sessions, exact, other)."""
    return sessions.groupBy("day").agg(F.count("*").alias("sessions"), F.count_if(F.col("provenance") == "exact").alias("exact"), F.count_if(F.col("provenance") != "exact").alias("other"))


def stage_segments(transitions: DataFrame) -> DataFrame:
    """(run, stage, at, until): a stage ends where the run's next one begins; the last stays open."""
    return transitions.withColumn("until", F.lead("at").over(Window.partitionBy("run").orderBy("at")))


def attribute_stalls(stalls: DataFrame, transitions: DataFrame) -> DataFrame:
    """Each stall (run, stall_id, from, to) with the stage that it overlaps most, the earliest on a tie, and its offset there.

    Time is cut into buckets of the stalls' own scale: a stall meets only the segments in force in its buckets, so a run with many stages
    and many stalls isn't a product of them.
    """
    size = stalls.agg(F.coalesce(F.max(F.col("to") - F.col("from")), F.lit(1.0))).first()[0] or 1.0
    at = lambda c: F.floor(c / size)
    ends = stalls.groupBy("run").agg(F.min(at(F.col("from"))).alias("lo"), F.max(at(F.col("to"))).alias("hi"))
    segments = stage_segments(transitions).join(ends, "run")
    # The first segment reaches back to the first stall, so that a stall before all stages meets it; the last one has no end.
    head = F.row_number().over(Window.partitionBy("run").orderBy("at")) == 1
    segments = segments.withColumn("head", head)
    first, last = F.when(F.col("head"), F.col("lo")).otherwise(F.greatest("lo", F.least("hi", at(F.col("at"))))), F.greatest("lo", F.least("hi", F.coalesce(at(F.col("until")), F.col("hi"))))
    segments = segments.withColumn("b", F.explode(F.sequence(first, last))).drop("lo", "hi", "head")
    spread = stalls.withColumn("b", F.explode(F.sequence(at(F.col("from")), at(F.col("to")))))
    met = spread.join(segments, ["run", "b"])
    overlap = F.least(F.col("to"), F.coalesce("until", F.lit(float("inf")))) - F.greatest("from", "at")
    best = met.withColumn("overlap", overlap).groupBy("run", "stall_id", "from", "to").agg(F.max(F.struct("overlap", (-F.col("at")).alias("minus"), "stage")).alias("b"))
    return best.select("run", "stall_id", "from", "to", F.col("b.stage").alias("stage"), F.greatest(F.lit(0.0), F.col("from") + F.col("b.minus")).alias("offset"))


def stall_summary(stalls: DataFrame) -> DataFrame:
    """(stage, count, total_ms, longest_ms)."""
    ms = F.col("to") - F.col("from")
    return stalls.groupBy("stage").agg(F.count("*").alias("count"), F.sum(ms).alias("total_ms"), F.max(ms).alias("longest_ms"))


def worst_stall(stalls: DataFrame) -> DataFrame:
    """One row: the longest stall with its stage and its offset there; the first of equals."""
    ms = F.col("to") - F.col("from")
    return stalls.withColumn("ms", ms).orderBy(F.desc("ms"), "from", "run", "stall_id").limit(1).select("run", "stall_id", "stage", "ms", "offset")


def expected_stages(timings: DataFrame, stages: list[str]) -> DataFrame:
    """Every expected stage with its time; stages without one did not run."""
    want = timings.sparkSession.createDataFrame(list(enumerate(stages)), "pos int, stage string")
    return want.join(timings, "stage", "left").withColumn("status", F.when(F.col("ms").isNull(), "did not run").otherwise("ran"))


def group_stats(values: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, lo, hi, mean, sd, median)."""
    v = F.col(value)
    return values.groupBy(by).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.median(v).alias("median"))
