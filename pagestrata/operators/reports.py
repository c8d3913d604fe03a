"""Reports over filtered pages and clusters, and the small state tables around them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.functions import fixed, text


def retention(reconciled: DataFrame) -> DataFrame:
    """Adds the share of raw rows kept, in percent."""
    return reconciled.withColumn("retention_pct", F.coalesce(F.try_divide(F.col("kept") * 100.0, F.col("raw")), F.lit(0.0)))


def cluster_report(members: DataFrame, pages: DataFrame, groups: DataFrame | None = None, near: int = 8, hosts: int = 3) -> DataFrame:
    """Per cluster of described ``members`` (cluster, id, sim, pos): size, visits, the ``near`` titles nearest to the centre with how many pages each stands for, and top domains."""
    rows = members.join(pages.select("id", "title", "domain", "visit_count"), "id")
    stands = groups.groupBy("group").agg(F.count("*").alias("stands"), F.min_by("id", "pos").alias("id")).select("id", "stands") if groups is not None else None
    rows = rows.join(stands, "id", "left") if stands is not None else rows.withColumn("stands", F.lit(1))
    rows = rows.withColumn("stands", F.coalesce("stands", F.lit(1)))
    named = F.concat("title", F.when(F.col("stands") > 1, F.concat(F.lit(" ×"), F.col("stands").cast("string"))).otherwise(""))
    top = rows.where(F.col("pos") <= near).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", named.alias("t")))), lambda x: x["t"]).alias("titles"))
    counts = rows.groupBy("cluster", "domain").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "domain"))
    best = counts.withColumn("r", rank).where(F.col("r") <= hosts).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "domain"))), lambda x: x["domain"]).alias("domains"))
    return rows.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("visit_count").alias("visits")).join(top, "cluster").join(best, "cluster")


def cluster_json(members: DataFrame) -> DataFrame:
    """A JSON row for each cluster with its members in order of similarity."""
    return members.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "sim"))).alias("nodes")).select(F.to_json(F.struct("cluster", F.size("nodes").alias("size"), "nodes")).alias("value"))


def same_clustering(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two (id, cluster) tables group the same ids alike, whatever the clusters are called."""
    canonical = lambda t, c: t.join(t.where("cluster IS NOT NULL").groupBy("cluster").agg(F.min("id").alias(c)), "cluster", "left").select("id", c)
    met = canonical(a, "a").join(canonical(b, "b"), "id", "full")
    return met.agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("same"))


def never_considered(pages: DataFrame, noise_pages: int) -> DataFrame:
    """One row: pages without a cluster, and how many of them clustering never saw."""
    return pages.agg(F.count_if(F.col("cluster_id").isNull()).alias("unclustered")).withColumn("never_considered", F.greatest(F.lit(0), F.col("unclustered") - noise_pages))


def settings(wanted: Column) -> Column:
    """Blocked categories: known ones in their fixed order; all if unset."""
    every = F.array(*map(F.lit, fixed.CATEGORIES))
    return F.when(wanted.isNull(), every).otherwise(F.filter(every, lambda c: F.array_contains(wanted, c)))


def toggled(blocked: Column, category: str, on: bool) -> Column:
    return settings(F.array_append(blocked, F.lit(category)) if on else F.array_remove(blocked, category))


def paused(now: int, minutes: int | None = None, indefinite: bool = False) -> tuple[int | None, bool]:
    """(until, indefinite) of a pause that begins now; neither resumes."""
    return (None, True) if indefinite else (now + minutes * 60_000 if minutes else None, False)


def pause_until(raw: Column) -> Column:
    """(until, indefinite) of a stored pause as JSON; anything but a number or "indefinite" reads as not paused."""
    until = F.try_variant_get(F.try_parse_json(raw), "$.until", "variant")
    kind = F.coalesce(F.schema_of_variant(until), F.lit("VOID"))
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.struct(F.when(number, F.try_variant_get(until, "$", "long")).alias("until"), F.coalesce((kind == "STRING") & (F.try_variant_get(until, "$", "string") == "indefinite"), F.lit(False)).alias("indefinite"))


def clustering_dump(nodes: DataFrame, groups: DataFrame, pages: DataFrame, facts: dict) -> DataFrame:
    """JSON lines of a whole clustering: one of ``facts`` (settings, counts), one a node and one a page.

    ``nodes``: (id, cluster, sim) by group, cluster null for noise. Pages name their node, nodes their cluster, so that no
    row grows with a cluster or a group.
    """
    spark = nodes.sparkSession
    sizes = groups.groupBy("group").agg(F.count("*").alias("collapsed"), F.min_by("id", "pos").alias("rep"))
    shown = nodes.withColumnRenamed("id", "group").join(sizes, "group").join(pages.select(F.col("id").alias("rep"), "title", "embed_text", "normalized_url", "visit_count"), "rep")
    kind = F.when(F.col("cluster").isNull(), "noise").otherwise("node").alias("kind")
    node = F.to_json(F.struct(kind, F.col("group").alias("node"), "cluster", "title", F.col("embed_text").alias("embedded"), F.col("normalized_url").alias("url"), F.col("visit_count").alias("visitCount"), "collapsed", F.round("sim", 4).alias("simToCentroid")))
    page = F.to_json(F.struct(F.lit("page").alias("kind"), F.col("group").alias("node"), F.col("normalized_url").alias("url")))
    first = spark.createDataFrame([(json.dumps({"kind": "facts"} | facts),)], "value string")
    return first.unionByName(shown.select(node.alias("value"))).unionByName(groups.join(pages.select("id", "normalized_url"), "id").select(page.alias("value")))


def aggressive_suffixes(titles: DataFrame, least: int = 3) -> DataFrame:
    """(tail, n): endings on at least ``least`` titles whatever their number; an experiment's variant."""
    return titles.select(text.tail(F.col("title")).alias("tail")).where("tail IS NOT NULL").groupBy("tail").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def without_names(title: Column) -> Column:
    """A title without capitalised words after the first; an experiment's variant."""
    words = F.split(title, " ")
    return F.array_join(F.filter(words, lambda w, i: (i == 0) | ~w.rlike(r"^\p{Lu}")), " ")


def median_run(runs: DataFrame, by: str, value: str) -> DataFrame:
    """The middle run of each ``by`` in order of a value."""
    order = Window.partitionBy(by).orderBy(value)
    return runs.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(by))).where("_r = (_n + 1) DIV 2").drop("_r", "_n")


def first_run(onboarded: bool, summary: DataFrame) -> bool:
    """Whether the first backfill is due: onboarded, and no summary yet."""
    return onboarded and summary.isEmpty()


def truncated(s: Column, most: int) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)
