"""Queries over activity: sessions, days and weeks, stages, live capture, visit sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.functions import times
from pagestrata.operators import sessions, store, views
from pagestrata.session import table
from pagestrata.sources import history
from pagestrata.streaming import capture

NOW = 1_706_745_600_000


def _visits(spark, d):
    e = table(spark, d, "events")
    ms = times.millis(F.col("ts"))
    return e.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("title"), F.col("event_type").alias("domain"), (ms - 1000).alias("first_visit"), ms.alias("last_visit"), (F.col("event_id") % 8).alias("active_seconds"), (F.col("event_id") % 5 > 0).alias("captured"))


def sessions_by_user(spark, d):
    s = sessions.build(_visits(spark, d), NOW, ["user_id"])
    return s.select("user_id", "session_id", "start", "end", "page_count", "active_seconds", "provenance", "provisional", "day", F.array_join(F.col("page_ids").cast("array<string>"), ",").alias("page_ids"))


def sessions_all(spark, d):
    return sessions.build(_visits(spark, d), NOW, gap=60_000, with_pages=False).select("session_id", "start", "end", "page_count", "passive")


def day_summary(spark, d):
    return views.day_counts(sessions.build(_visits(spark, d), NOW, ["user_id"]))


def session_names(spark, d):
    rows = sessions.number_runs(_visits(spark, d), ["user_id"])
    rows = rows.withColumn("s", F.concat_ws("-", "user_id", "run"))
    return views.fallback_names(rows, "s", ["last_visit", "id"])


def _pages(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("c"), (F.col("user_id") % 12).cast("string")).alias("cluster_id"), F.when(F.col("user_id") % 12 < 10, F.concat(F.lit("topic "), (F.col("user_id") % 12).cast("string"))).alias("label"), F.col("event_type").alias("domain"), times.millis(F.col("ts")).alias("last_visit"), F.when(F.col("event_id") % 2 == 0, "x").alias("text"), F.col("event_type").alias("title"), F.col("value").alias("visit_count"))


def weekly_topics(spark, d):
    return views.weekly_topics(_pages(spark, d))


def weekly_excluded(spark, d):
    return views.excluded(_pages(spark, d))


def topic_cards(spark, d):
    return views.topic_cards(_pages(spark, d)).select("cluster_id", "pages", "last_touched", F.array_join(F.col("activity").cast("array<string>"), ",").alias("activity"))


def domain_facet(spark, d):
    return views.facet(_pages(spark, d), "domain")


def top_domains(spark, d):
    return views.top_per(_pages(spark, d), "cluster_id", "domain", 3)


def page_summary(spark, d):
    return views.summary(_pages(spark, d))


def _stages(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), times.millis(F.col("ts")).cast("double").alias("at"))


def _stalls(spark, d):
    at = times.millis(F.col("ts")).cast("double")
    return table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("stall_id"), (at - 3_600_000).alias("from"), (at + 1_800_000).alias("to"))


def stall_stages(spark, d):
    return views.attribute_stalls(_stalls(spark, d), _stages(spark, d))


def stall_summary(spark, d):
    return views.stall_summary(views.attribute_stalls(_stalls(spark, d), _stages(spark, d)))


def worst_stall(spark, d):
    stalls = _stalls(spark, d).withColumn("to", F.col("to") + F.col("stall_id") % 97)
    return views.worst_stall(views.attribute_stalls(stalls, _stages(spark, d)))


def day_navigation(spark, d):
    return views.days(sessions.build(_visits(spark, d), NOW, ["user_id"], with_pages=False))


def visit_window(spark, d):
    return views.visit_window(_pages(spark, d))


def newest_pages(spark, d):
    return views.newest(_pages(spark, d)).select("id", "last_visit")


def newest_captures(spark, d):
    return views.captured_newest(_pages(spark, d)).select("id", "preview")


def best_resources(spark, d):
    return views.best_resources(_pages(spark, d).withColumn("visit_count", F.col("id") % 17)).select("id", "visit_count")


def tier_histogram(spark, d):
    return views.tiers(_pages(spark, d).withColumn("extraction_tier", F.col("id") % 5))


def vector_mix(spark, d):
    return views.vector_mix(_pages(spark, d).withColumn("vector_source", F.when(F.col("text").isNull(), "title").otherwise("text")))


def stage_report(spark, d):
    ran = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("ms"))
    return views.expected_stages(ran, ["click", "view", "embed", "cluster"])


def group_stats(spark, d):
    s = views.group_stats(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")
    return s.select("l_returnflag", "n", "lo", "hi", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "median")


def dwell_clock(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("tab"), F.expr("unix_millis(CAST(ts AS TIMESTAMP)) DIV 60000").alias("at"), F.col("event_type").alias("key"), (F.col("event_id") % 4 > 0).alias("focused"), F.lit(0).cast("long").alias("last_input"), "event_id")
    return capture.dwell(t.withColumn("at", F.col("at") * 1000 + F.col("event_id") % 1000)).select("tab", "key", "island", "focused_ms", "active_seconds")


def history_windows(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("url"), F.lit("").alias("title"), times.millis(F.col("ts")).alias("last_visit"), F.lit(None).cast("long").alias("visit_count"))
    return history.full_windows(history.read_windows(rows, NOW), 1_000)


def history_join(spark, d):
    urls = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("url"), F.col("c_name").alias("title"), F.lit(1).cast("long").alias("visit_count"), F.lit(0).cast("long").alias("typed_count"), F.when(F.col("c_custkey") % 9 == 0, 0).otherwise(F.lit(13_350_000_000_000_000) + F.col("c_custkey")).cast("long").alias("last_visit_time"))
    seen = table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("url_id"), (F.lit(13_340_000_000_000_000) + F.col("o_orderkey") * 1_000_000).cast("long").alias("visit_time"))
    return history.join_visits(urls, seen)


def time_days(spark, d):
    ms, e = times.millis(F.col("ts")), table(spark, d, "events")
    return e.select("event_id", times.day_start(ms).alias("day"), times.week_start(ms).alias("week"), times.iso(ms).alias("iso"), times.is_paused(ms, F.col("event_id") % 7 == 0, F.lit(NOW - 864_000_000)).alias("paused"), times.opacity(F.col("event_id") % 100 / 100).alias("opacity"), times.timeline_x(ms, times.day_start(ms)).alias("x"))


def time_texts(spark, d):
    ms, e = times.millis(F.col("ts")), table(spark, d, "events")
    return e.select("event_id", times.clock(ms).alias("clock"), times.time_range(ms, ms + 3_600_000 * (F.col("event_id") % 60)).alias("span"), times.remaining(ms % 100_000_000).alias("left_over"), times.ago(ms, F.lit(NOW)).alias("ago"), times.day_label(times.day_start(ms), F.lit(NOW)).alias("label"))


def settled_bursts(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return capture.debounced(e, "user_id", "6 hours").select("user_id", times.millis(F.col("due")).alias("due"), "captures")


def format_texts(spark, d):
    ms, e = F.col("event_id") * 370 % 50_000, table(spark, d, "events")
    return e.select("event_id", times.took(ms).alias("took"), times.week_label(times.week_start(times.millis(F.col("ts")))).alias("week"), F.format_number(F.col("event_id") * 1_001, 0).alias("count"))


def queue_latest(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_type", F.col("event_id").alias("queued_at"))
    return store.latest(e, "id", "queued_at")


def range_scan(spark, d):
    return store.in_range(_pages(spark, d), 1_705_000_000_000, 1_705_500_000_000)


QUERIES = {f.__name__: f for f in (sessions_by_user, sessions_all, day_summary, session_names, weekly_topics, weekly_excluded, topic_cards, domain_facet, top_domains, page_summary, stall_stages, stall_summary, worst_stall, day_navigation, visit_window, newest_pages, newest_captures, best_resources, tier_histogram, vector_mix, stage_report, group_stats, dwell_clock, history_windows, history_join, time_days, time_texts, settled_bursts, format_texts, queue_latest, range_scan)}

_V = "SELECT event_id AS id, user_id, event_type AS title, event_type AS domain, (epoch_us(ts) // 1000) - 1000 AS first_visit, (epoch_us(ts) // 1000) AS last_visit, event_id % 8 AS active_seconds, event_id % 5 > 0 AS captured FROM events"
_DAY = "(((({0}) - 14400000) // 86400000) * 86400000 + 14400000)"


def _runs(by: str, gap: int) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT *, sum(brk) OVER ({part}ORDER BY last_visit, id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN last_visit - lag(last_visit) OVER ({part}ORDER BY last_visit, id) <= {gap} THEN 0 ELSE 1 END AS brk FROM ({_V}))"


_SESSIONS = f"""SELECT user_id, 's' || min(first_visit) || '-' || count(*) || '-' || arg_min(id, (last_visit, id)) AS session_id, min(first_visit) AS start, max(last_visit) AS "end", count(*) AS page_count, CAST(sum(active_seconds) AS BIGINT) AS active_seconds,
CASE WHEN bool_and(captured) THEN 'exact' WHEN NOT bool_or(captured) THEN 'approximate' ELSE 'mixed' END AS provenance, {NOW} - max(last_visit) < 1800000 AS provisional, {_DAY.format("min(first_visit)")} AS day, string_agg(id, ',' ORDER BY last_visit, id) AS page_ids FROM ({_runs("user_id", 1800000)}) GROUP BY user_id, run"""
_P = "SELECT event_id AS id, 'c' || (user_id % 12) AS cluster_id, CASE WHEN user_id % 12 < 10 THEN 'topic ' || (user_id % 12) END AS label, event_type AS domain, (epoch_us(ts) // 1000) AS last_visit, CASE WHEN event_id % 2 = 0 THEN 'x' END AS text FROM events"
_TOP = f"SELECT cluster_id, count(*) AS total FROM ({_P}) WHERE label IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"
_ST = 'SELECT user_id AS run, event_type AS stage, CAST((epoch_us(ts) // 1000) AS DOUBLE) AS "at" FROM events'
_STALL = f"""WITH seg AS (SELECT *, coalesce(lead("at") OVER (PARTITION BY run ORDER BY "at"), 'inf'::DOUBLE) AS until FROM ({_ST})),
st AS (SELECT user_id AS run, event_id AS stall_id, CAST((epoch_us(ts) // 1000) AS DOUBLE) - 3600000 AS f, CAST((epoch_us(ts) // 1000) AS DOUBLE) + 1800000 AS t FROM events),
b AS (SELECT st.run, stall_id, f, t, stage, "at", row_number() OVER (PARTITION BY st.run, stall_id ORDER BY least(t, until) - greatest(f, "at") DESC, "at", stage DESC) AS r FROM st JOIN seg ON st.run = seg.run)
"""

SQL = {
    "sessions_by_user": _SESSIONS,
    "sessions_all": f"""WITH r AS ({_runs("", 60000)}),
i AS (SELECT *, coalesce(lead(last_visit) OVER w - last_visit <= 180000, TRUE) AND active_seconds <= 5 AS idle, coalesce(lag(domain) OVER w = domain, TRUE) AS same FROM r WINDOW w AS (PARTITION BY run ORDER BY last_visit, id)),
g AS (SELECT *, sum(CASE WHEN idle AND same THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY last_visit, id ROWS UNBOUNDED PRECEDING) AS island FROM i),
s AS (SELECT run, island, count(*) FILTER (idle) AS n FROM g GROUP BY 1, 2), l AS (SELECT run, max(n) AS longest FROM s GROUP BY 1)
SELECT 's' || min(first_visit) || '-' || count(*) || '-' || arg_min(id, (last_visit, id)) AS session_id, min(first_visit) AS start, max(last_visit) AS "end", count(*) AS page_count, CASE WHEN NOT bool_or(captured) THEN NULL WHEN count(*) < 5 THEN FALSE ELSE any_value(longest) >= 5 AND any_value(longest) * 2 >= count(*) END AS passive FROM r JOIN l USING (run) GROUP BY run""",
    "day_summary": f"SELECT day, count(*) AS sessions, count(*) FILTER (provenance = 'exact') AS exact, count(*) FILTER (provenance <> 'exact') AS other FROM ({_SESSIONS}) GROUP BY day",
    "session_names": f"""WITH r AS (SELECT *, first_value(last_visit) OVER (PARTITION BY user_id, run ORDER BY last_visit, id) AS s0, row_number() OVER (PARTITION BY user_id, run ORDER BY last_visit, id) AS k FROM ({_runs("user_id", 1800000)}))
SELECT user_id || '-' || any_value(s0) AS s, string_agg(title, ' · ' ORDER BY k) FILTER (k <= 3) || CASE WHEN count(*) > 3 THEN ' +' || (count(*) - 3) || ' more' ELSE '' END AS name FROM r GROUP BY user_id, run""",
    "weekly_topics": f"""WITH t AS ({_TOP}), c AS (SELECT epoch_ms(date_trunc('week', make_timestamp(last_visit * 1000))) AS week, cluster_id, count(*) AS n FROM ({_P}) JOIN t USING (cluster_id) WHERE label IS NOT NULL GROUP BY 1, 2)
SELECT w.week, t.cluster_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT week FROM c) w CROSS JOIN t LEFT JOIN c ON c.week = w.week AND c.cluster_id = t.cluster_id""",
    "weekly_excluded": f"SELECT CAST(count(*) - (SELECT sum(total) FROM ({_TOP})) AS BIGINT) AS excluded_pages, (count(*) - (SELECT sum(total) FROM ({_TOP}))) * 100.0::DOUBLE / count(*) AS excluded_pct FROM ({_P})",
    "topic_cards": f"""WITH p AS ({_P}), e AS (SELECT cluster_id, count(*) AS pages, min(last_visit) AS lo, max(last_visit) AS hi FROM p GROUP BY 1),
b AS (SELECT cluster_id, CASE WHEN hi = lo THEN 19 ELSE least(19, CAST(floor((last_visit - lo) / (hi - lo) * 20) AS INT)) END AS k, count(*) AS n FROM p JOIN e USING (cluster_id) GROUP BY 1, 2)
SELECT e.cluster_id, pages, hi AS last_touched, (SELECT string_agg(coalesce(b.n, 0), ',' ORDER BY i.k) FROM range(20) i(k) LEFT JOIN b ON b.k = i.k AND b.cluster_id = e.cluster_id) AS activity FROM e""",
    "domain_facet": f"SELECT domain, count(*) AS n FROM ({_P}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40",
    "top_domains": f"SELECT * FROM (SELECT cluster_id, domain, count(*) AS n, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, domain) AS INT) AS rank FROM ({_P}) GROUP BY 1, 2) WHERE rank <= 3",
    "page_summary": f"SELECT count(*) AS pages, count(text) AS captured, count(cluster_id) AS clustered, count(*) - count(cluster_id) AS unclustered, count(DISTINCT {_DAY.format('last_visit')}) AS days, min(last_visit) AS oldest FROM ({_P})",
    "stall_stages": _STALL + 'SELECT run, stall_id, f AS "from", t AS "to", stage, greatest(0.0, f - "at") AS "offset" FROM b WHERE r = 1',
    "stall_summary": _STALL + "SELECT stage, count(*) AS count, sum(t - f) AS total_ms, max(t - f) AS longest_ms FROM b WHERE r = 1 GROUP BY stage",
    "worst_stall": _STALL.replace("+ 1800000 AS t", "+ 1800000 + event_id % 97 AS t") + 'SELECT run, stall_id, stage, t - f AS ms, greatest(0.0, f - "at") AS "offset" FROM b WHERE r = 1 ORDER BY ms DESC, f, run, stall_id LIMIT 1',
    "day_navigation": f"SELECT day, lag(day) OVER (ORDER BY day) AS earlier, lead(day) OVER (ORDER BY day) AS later FROM (SELECT DISTINCT day FROM ({_SESSIONS}))",
    "visit_window": f"SELECT strftime(make_timestamp(min(last_visit) * 1000), '%Y-%m-%d') AS oldest, strftime(make_timestamp(max(last_visit) * 1000), '%Y-%m-%d') AS newest FROM ({_P})",
    "newest_pages": f"SELECT id, last_visit FROM ({_P}) ORDER BY last_visit DESC, id LIMIT 100",
    "newest_captures": f"SELECT id, text AS preview FROM ({_P}) WHERE text IS NOT NULL ORDER BY last_visit DESC, id LIMIT 25",
    "best_resources": f"SELECT id, id % 17 AS visit_count FROM ({_P}) WHERE id % 17 > 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "tier_histogram": f"SELECT id % 5 AS extraction_tier, count(*) AS n FROM ({_P}) WHERE text IS NOT NULL GROUP BY 1",
    "vector_mix": f"SELECT count(*) - count(text) AS title, count(text) AS text FROM ({_P})",
    "stage_report": "SELECT pos, s.stage, ms, CASE WHEN ms IS NULL THEN 'did not run' ELSE 'ran' END AS status FROM (VALUES (0, 'click'), (1, 'view'), (2, 'embed'), (3, 'cluster')) s(pos, stage) LEFT JOIN (SELECT event_type AS stage, count(*) AS ms FROM events GROUP BY 1) e USING (stage)",
    "group_stats": "SELECT l_returnflag, count(l_quantity) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd, median(l_quantity) AS median FROM lineitem GROUP BY 1",
    "dwell_clock": """WITH t AS (SELECT user_id AS tab, (epoch_us(ts) // 1000) // 60000 * 1000 + event_id % 1000 AS "at", event_type AS key, event_id % 4 > 0 AS focused FROM events),
g AS (SELECT *, least(1500, coalesce("at" - lag("at") OVER w, 0)) AS gap, coalesce(lag(key) OVER w <> key, TRUE) AS new FROM t WINDOW w AS (PARTITION BY tab ORDER BY "at")),
i AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY tab ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT tab, key, island, CAST(sum(CASE WHEN focused AND NOT new THEN gap ELSE 0 END) AS BIGINT) AS focused_ms, CAST(0 AS BIGINT) AS active_seconds FROM i GROUP BY 1, 2, 3""",
    "history_windows": f"""SELECT w AS "window", count(*) AS n, count(*) >= 1000 AS maybe_truncated FROM events, range(13) r(w) WHERE (epoch_us(ts) // 1000) BETWEEN {NOW} - (w + 1) * 604800000 AND {NOW} - w * 604800000 GROUP BY 1""",
    "history_join": """SELECT c_name AS url, c_name AS title, CAST(floor((13350000000000000 + c_custkey) / 1000) AS BIGINT) - 11644473600000 AS last_visit, CAST(1 AS BIGINT) AS visit_count, CAST(0 AS BIGINT) AS typed_count, coalesce((13340000000000000 + min(o_orderkey) * 1000000) // 1000 - 11644473600000, 0) AS first_visit, c_custkey AS seq
FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 9 <> 0 GROUP BY c_name, c_custkey""",
    "time_days": f"""SELECT event_id, {_DAY.format("m")} AS day, epoch_us(date_trunc('week', make_timestamp(m * 1000))) // 1000 AS week, strftime(make_timestamp(m * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, event_id % 7 = 0 OR {NOW - 864_000_000} < m AS paused,
0.55::DOUBLE + (least(0.95::DOUBLE, greatest(0.3::DOUBLE, event_id % 100 / 100)) - 0.3::DOUBLE) / {0.95 - 0.30!r}::DOUBLE * {1 - 0.55!r}::DOUBLE AS opacity, (m - {_DAY.format("m")}) / 86400000 * 100::DOUBLE AS x FROM (SELECT event_id, epoch_us(ts) // 1000 AS m FROM events)""",
    "time_texts": f"""WITH t AS (SELECT event_id, make_timestamp(m * 1000) AS a, make_timestamp((m + 3600000 * (event_id % 60)) * 1000) AS b, CAST(ceil((m % 100000000) / 60000.0::DOUBLE) AS BIGINT) AS k, ({NOW} - m) // 60000 AS g, {_DAY.format("m")} AS d FROM (SELECT event_id, epoch_us(ts) // 1000 AS m FROM events)),
u AS (SELECT *, date_diff('day', a::DATE, b::DATE) AS n, date_diff('day', make_timestamp(d * 1000)::DATE, make_timestamp({NOW} * 1000)::DATE) AS q FROM t)
SELECT event_id, lower(strftime(a, '%-I:%M%p')) AS clock, CASE WHEN strftime(a, '%p') = strftime(b, '%p') THEN strftime(a, '%-I:%M') ELSE lower(strftime(a, '%-I:%M%p')) END || '–' || lower(strftime(b, '%-I:%M%p')) || CASE n WHEN 0 THEN '' WHEN 1 THEN ' (next day)' ELSE ' (+' || n || ' days)' END AS span,
CASE WHEN k < 60 THEN k || ' min' WHEN k % 60 = 0 THEN (k // 60) || 'h' ELSE (k // 60) || 'h ' || (k % 60) || 'm' END AS left_over,
CASE WHEN g < 1 THEN 'just now' WHEN g < 60 THEN g || ' min ago' WHEN g < 1440 THEN (g // 60) || 'h ' || (g % 60) || 'm ago' ELSE (g // 1440) || 'd ago' END AS ago,
CASE q WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE strftime(make_timestamp(d * 1000), '%a, %b %-d') END AS label FROM u""",
    "settled_bursts": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS brk FROM events),
r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, epoch_us(max(ts)) // 1000 + 21600000 AS due, count(*) AS captures FROM r GROUP BY user_id, run""",
    "format_texts": """SELECT event_id, CASE WHEN event_id * 370 % 50000 < 1000 THEN (event_id * 370 % 50000) || 'ms' ELSE printf('%.2fs', event_id * 370 % 50000 / 1000.0::DOUBLE) END AS took,
strftime(date_trunc('week', make_timestamp(epoch_us(ts))), '%b %-d') AS week, format('{:,}', event_id * 1001) AS "count" FROM events""",
    "queue_latest": "SELECT user_id AS id, arg_max(event_type, event_id) AS event_type, max(event_id) AS queued_at FROM events GROUP BY 1",
    "range_scan": "SELECT event_id AS id FROM events WHERE (epoch_us(ts) // 1000) BETWEEN 1705000000000 AND 1705500000000",
}
