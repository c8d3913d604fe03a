"""Queries that show whole tables in order, each row with its place."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.operators import filtering, ordering, sessions, vectors, views
from pagestrata.plans import activity, pages, similarity


def survivor_order(spark, d):
    return ordering.survivors(filtering.filter_visits(pages.visits(spark, d)).pages).select("normalized_url", "last_visit", "place")


def _some_clustered(spark, d):
    return activity._pages(spark, d).withColumn("cluster_id", F.when(F.col("id") % 3 > 0, F.col("cluster_id")))


def cluster_order(spark, d):
    return ordering.clusters(_some_clustered(spark, d))


def noise_order(spark, d):
    return ordering.noise(_some_clustered(spark, d))


def group_order(spark, d):
    return ordering.groups(vectors.collapse(spark, similarity._rows(spark, d), 0.5))


def card_order(spark, d):
    return ordering.cards(views.topic_cards(activity._pages(spark, d))).select("cluster_id", "pages", "place")


def timeline_order(spark, d):
    built = sessions.build(activity._visits(spark, d), activity.NOW, ["user_id"], with_pages=False)
    return ordering.timeline(built).select("day", "start", "session_id", "place")


QUERIES = {f.__name__: f for f in (survivor_order, cluster_order, noise_order, group_order, card_order, timeline_order)}

SQL = {
    "survivor_order": pages._FILTER.replace("max(last_visit) AS last_visit,", "max(last_visit) AS last_visit, min(seq) AS seq,", 1) + "SELECT normalized_url, last_visit, row_number() OVER (ORDER BY last_visit DESC, seq) - 1 AS place FROM k WHERE reason IS NULL",
    "cluster_order": f"SELECT cluster_id, count(*) AS members, row_number() OVER (ORDER BY count(*) DESC, cluster_id) - 1 AS place FROM ({activity._P}) WHERE id % 3 > 0 GROUP BY 1",
    "noise_order": f"SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM ({activity._P}) WHERE id % 3 = 0",
    "group_order": f"""SELECT representative, members, row_number() OVER (ORDER BY representative) - 1 AS place FROM (SELECT arg_min(id, pos) AS representative, count(*) AS members FROM ({similarity.SQL["near_groups"]}) GROUP BY "group") WHERE members > 1""",
    "card_order": f"SELECT cluster_id, count(*) AS pages, row_number() OVER (ORDER BY count(*) DESC, cluster_id) - 1 AS place FROM ({activity._P}) GROUP BY 1",
    "timeline_order": f"SELECT day, start, session_id, row_number() OVER (ORDER BY day DESC, start, session_id) - 1 AS place FROM ({activity._SESSIONS})",
}
