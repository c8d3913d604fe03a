"""Queries over fixed cases for rules that the tables hardly reach, with what each rule must say; and shapes of history exports."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import functions as F

from pagestrata.functions import fixed, text, times, urls
from pagestrata.operators import filtering
from pagestrata.session import shared_folder
from pagestrata.sources import history

#: (host, local)
HOSTS = (
    ("localhost", True), ("app.localhost", True), ("printer.local", True), ("[::1]", True), ("0.0.0.0", True), ("host.docker.internal", True), ("127.8.0.1", True), ("10.1.2.3", True), ("192.168.0.9", True),
    ("169.254.1.1", True), ("172.16.0.1", True), ("172.31.9.9", True), ("172.15.0.1", False), ("172.32.0.1", False), ("11.0.0.1", False), ("local.example.com", False), ("example.com", False),
)
#: (url, category or none)
SITES = (
    ("https://netbanking.anybank.com/", "banking"), ("https://my.netbanking.anybank.com/x", "banking"), ("https://stripe.com/dashboard/x", "banking"), ("https://stripe.com/docs", "none"), ("https://www.chase.com/", "banking"),
    ("https://notchase.com/", "none"), ("https://mail.google.com/x", "email"), ("https://www.webmd.com/a", "health"), ("https://x.irs.gov/", "government-id"), ("https://okta.com/", "corporate"), ("https://team.okta.com/", "corporate"),
    ("https://wiki.corp.example.com/", "corporate"), ("https://jira.example.io/b", "corporate"), ("https://sso.somesite.com/", "none"), ("https://example.com/", "none"),
)
#: (url, search page)
SEARCHES = (
    ("https://google.com/", True), ("https://www.google.co.uk/search?q=a", True), ("https://google.com/maps/place/x", False), ("https://www.bing.com/search?q=a", True), ("https://duckduckgo.com/?q=a", True),
    ("https://site.com/search?q=x", True), ("https://site.com/search", False), ("https://site.com/article?q=x", False), ("https://site.com/a/results?query=x", True), ("https://example.com/", False),
)
#: (title, bare)
TITLES = (
    ("https://example.com/a/very/long/path/of/things", True), ("example.com/a/very/long/path/of/things", True), ("d41d8cd98f00b204e9800998ecf8427e.pdf", True), ("something_without_spaces?and=query", True),
    ("https://example.com/short", False), ("A title of several words that is long enough", False), ("Wörter-ohne-Leerzeichen-aber-nicht-ASCII?x=1", False), ("justonelongwordwithoutanymarksinit", False),
)
#: (url, title, reason or kept) of the whole chain with all categories blocked.
CHAIN = (
    ("", "An empty address of a visit", "no-url"), ("not a url", "A broken address of a visit", "no-url"), ("ftp://example.com/a", "A file transfer of some kind", "scheme"), ("chrome://settings/", "Settings of the whole browser", "scheme"),
    ("http://localhost:8080/x", "A page that is being developed", "localhost"), ("http://10.0.0.7/", "A page of the router at home", "localhost"), ("https://www.chase.com/", "A bank and its many accounts", "blocked"),
    ("https://mail.google.com/mail", "A letter in the mail of today", "blocked"), ("https://www.google.com/search?q=a", "a - search of the whole web", "search"), ("https://shop.example/search?q=hat", "Hats that were found in the shop", "search"),
    ("https://one.example/a", "Untitled", "junk-title"), ("https://two.example/a", "A short one", "short-title"), ("https://three.example/garden-soil-notes/first-steps", "https://three.example/garden-soil-notes/first-steps", "kept"),
    ("https://four.example/8f14e45fceea167a", "https://four.example/8f14e45fceea167a", "junk-title"), ("https://five.example/a", "A perfectly good title of a page", "kept"),
)


def _rows(spark, cases, schema):
    return spark.createDataFrame(cases, schema)


def local_hosts(spark, d):
    return _rows(spark, [(h,) for h, _ in HOSTS], "host string").select("host", urls.is_local(F.col("host")).alias("is_local"))


def sensitive_sites(spark, d):
    """The category of each site, blocked or not, and whether it is blocked while only banking and email are."""
    rows = _rows(spark, [(u,) for u, _ in SITES], "url string").withColumn("category", urls.sensitive(urls.parts(F.col("url"))))
    some = filtering.first_pass(rows, ("banking", "email"))
    return some.select("url", F.coalesce("category", F.lit("none")).alias("category"), F.coalesce(F.col("reason") == "blocked", F.lit(False)).alias("blocked"))


def search_pages(spark, d):
    return _rows(spark, [(u,) for u, _ in SEARCHES], "url string").select("url", urls.is_search_page(urls.parts(F.col("url"))).alias("is_search"))


def bare_titles(spark, d):
    return _rows(spark, [(t,) for t, _ in TITLES], "title string").select("title", text.is_bare_url(F.col("title")).alias("bare"))


def drop_chain(spark, d):
    """The reason of each case through both passes; what no pass drops is kept."""
    visits = _rows(spark, [(u, t, i) for i, (u, t, _) in enumerate(CHAIN)], "url string, title string, seq long").select("url", "title", F.lit(1_700_000_000_000).alias("last_visit"), F.lit(1).cast("long").alias("visit_count"), F.lit(0).cast("long").alias("typed_count"), "seq")
    found = filtering.filter_visits(visits, categories=fixed.CATEGORIES)
    second = found.judged.select("seq", F.col("reason").alias("late"))
    return found.raw.select("url", "seq", "reason").join(second, "seq", "left").select("url", F.coalesce("reason", "late", F.lit("kept")).alias("reason"))


def _written(spark, value) -> str:
    """The folder of a JSON file, written where all executors see it."""
    place = f"{shared_folder(spark)}/shapes-{uuid4().hex}"
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(place)
    return place


def takeout_shape(spark, d):
    items = [{"title": f"t{i}", "url": f"https://a.example/{i}", "time_usec": 1_700_000_000_000_000 + i * 1_500} for i in range(5)]
    return history.read_takeout(spark, _written(spark, {"Browser History": items})).select("url", "title", "last_visit", "seq")


def item_shape(spark, d):
    items = [{"url": f"https://a.example/{i}", "title": f"t{i}", ("lastVisitTime", "last_visit_time", "time")[i % 3]: 1_700_000_000_000.25 + i, "visitCount": i} for i in range(6)]
    return history.read_items(spark, _written(spark, {"history": items})).select("url", "title", "last_visit", "visit_count", "seq")


def input_times(spark, d):
    """Times to date-and-time fields and back, and the midnight before."""
    ms = F.lit(1_700_000_000_000) + F.col("id") * 12_345_678
    rows = spark.range(50).select("id", ms.alias("ms"))
    return rows.select("id", times.to_input(F.col("ms")).alias("field"), times.from_input(times.to_input(F.col("ms"))).alias("back"), times.calendar_day_start(F.col("ms")).alias("midnight"), times.from_input(F.lit("soon")).alias("unreadable"))


QUERIES = {f.__name__: f for f in (local_hosts, sensitive_sites, search_pages, bare_titles, drop_chain, takeout_shape, item_shape, input_times)}


def _values(cases, names: str) -> str:
    literal = lambda v: str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, c)) + ')' for c in cases)}) c({names})"


SQL = {
    "local_hosts": _values(HOSTS, "host, is_local"),
    "sensitive_sites": f"SELECT url, category, category IN ('banking', 'email') AS blocked FROM ({_values(SITES, 'url, category')})",
    "search_pages": _values(SEARCHES, "url, is_search"),
    "bare_titles": _values(TITLES, "title, bare"),
    "drop_chain": _values([(u, r) for u, _, r in CHAIN], "url, reason"),
    "takeout_shape": "SELECT 'https://a.example/' || i AS url, 't' || i AS title, (1700000000000000 + i * 1500) // 1000 AS last_visit, i AS seq FROM range(5) r(i)",
    "item_shape": "SELECT 'https://a.example/' || i AS url, 't' || i AS title, 1700000000000 + i AS last_visit, i AS visit_count, i AS seq FROM range(6) r(i)",
    "input_times": """SELECT i AS id, strftime(make_timestamp(m * 1000), '%Y-%m-%dT%H:%M') AS field, m // 60000 * 60000 AS back, m // 86400000 * 86400000 AS midnight, CAST(NULL AS BIGINT) AS unreadable
FROM (SELECT i, 1700000000000 + i * 12345678 AS m FROM range(50) r(i))""",
}
