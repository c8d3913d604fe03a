"""Queries over web pages: URL and text functions, the filter chain, the extraction ladder, tables of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions import fixed, text, times, urls
from pagestrata.operators import filtering, store
from pagestrata.session import table
from pagestrata.streaming import capture

T0 = 1_704_067_200_000


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as visits: the title from the markup, times and counts from the id."""
    p = table(spark, sf_dir, "pages")
    return p.select("url", text.html_title(F.col("html")).alias("title"), (F.lit(T0) + F.col("page_id") * 137_000).alias("last_visit"), (1 + F.col("page_id") % 5).alias("visit_count"), (F.col("page_id") % 3).alias("typed_count"), F.col("page_id").alias("seq"))


def url_parts(spark, d):
    u = table(spark, d, "pages").withColumn("u", urls.parts(F.col("url")))
    return u.select("page_id", urls.domain(F.col("u")).alias("domain"), F.col("u.path").alias("path"), F.col("u.query").alias("query"), F.col("u.fragment").alias("fragment"), urls.is_local(F.col("u.host")).alias("is_local"), urls.page_format(F.col("u")).alias("format"))


def normalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalize(urls.parts(F.col("url"))).alias("normalized_url"))


def url_identity(spark, d):
    u = table(spark, d, "pages").withColumn("u", urls.parts(F.col("url")))
    return u.select("page_id", urls.hash_id(urls.normalize(F.col("u"))).alias("id"), urls.stable_search(F.col("u.query")).alias("stable"), urls.navigation_key(F.col("u")).alias("navigation"), urls.is_search_page(F.col("u")).alias("is_search"), F.coalesce(urls.sensitive(F.col("u")), F.lit("none")).alias("category"), urls.favicon(F.col("url")).alias("favicon"))


def url_words(spark, d):
    w = table(spark, d, "pages").withColumn("w", urls.path_words(F.col("url")))
    return w.select("page_id", F.array_join("w.words", " ").alias("words"), (F.size("w.path_only") >= 2).alias("usable"))


def title_tails(spark, d):
    return filtering.boilerplate(visits(spark, d).select(text.tidy(F.col("title")).alias("title")), least=1, share=0.0)


def title_checks(spark, d):
    t = visits(spark, d).select("seq", text.tidy(F.col("title")).alias("title"))
    return t.select(F.col("seq").alias("page_id"), "title", text.utf16_length(F.col("title")).cast("long").alias("units"), text.is_bare_url(F.col("title")).alias("bare"), text.is_junk(F.col("title"), F.col("title")).alias("junk"))


def fold_visits(spark, d):
    return filtering.fold(_event_rows(spark, d), per_visit=False)


def fold_per_visit(spark, d):
    return filtering.fold(_event_rows(spark, d), per_visit=True)


def _event_rows(spark, d):
    e = table(spark, d, "events")
    site = F.concat(F.lit("https://"), "event_type", F.lit(".example/"), F.col("user_id").cast("string"))
    return e.select(site.alias("normalized_url"), F.concat(site, F.lit("?v="), F.col("event_id").cast("string")).alias("url"), F.col("event_type").alias("domain"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("title"), times.millis(F.col("ts")).alias("last_visit"), (1 + F.col("event_id") % 7).alias("visit_count"), (F.col("event_id") % 2).alias("typed_count"), F.col("event_id").alias("seq"))


def filter_pages(spark, d):
    p = filtering.filter_visits(visits(spark, d)).pages
    return p.select("normalized_url", "url", "domain", "title", "embed_text", "path_rescued", "last_visit", "visit_count", "typed_count")


def filter_audit(spark, d):
    return filtering.filter_visits(visits(spark, d)).drops


def filter_reconcile(spark, d):
    return filtering.reconcile(filtering.filter_visits(visits(spark, d)))


def filter_samples(spark, d):
    return filtering.samples(filtering.filter_visits(visits(spark, d)))


def junk_titles(spark, d):
    """Distinct dropped titles with counts."""
    return filtering.filter_visits(visits(spark, d)).judged.where("reason = 'junk-title'").groupBy("title").agg(F.count("*").alias("n"))


def extraction(spark, d):
    p = table(spark, d, "pages").withColumn("u", urls.parts(F.col("url")))
    best = text.ladder(text.rungs(F.col("html"), F.col("u")), F.length(text.html_text(F.col("html"))))
    return p.withColumn("b", best).select("page_id", F.col("b.tier").alias("tier"), F.length("b.text").alias("n_chars"), F.col("b.quality.score").alias("score"), F.col("b.quality.verdict").alias("verdict"))


def text_quality(spark, d):
    q = table(spark, d, "documents").withColumn("q", text.quality(F.col("text"), F.col("n_chars") * 2))
    return q.select("doc_id", "q.*")


def preview_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.cap(F.col("text"), text.PREVIEW).alias("preview"))


def capture_gate(spark, d):
    c = table(spark, d, "pages").select("page_id", "url", (F.col("page_id") % 11 == 0).alias("incognito"))
    return capture.gate(c).select("page_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


def page_rows(spark, d):
    """A page table: of visits, with format and an id."""
    v = visits(spark, d).withColumn("u", urls.parts(F.col("url")))
    return v.select(F.col("seq").cast("string").alias("id"), "url", urls.normalize(F.col("u")).alias("normalized_url"), "title", F.lit("").alias("text"), urls.page_format(F.col("u")).alias("format"), F.array().cast("array<string>").alias("topics"), F.lit(4).alias("extraction_tier"), (F.col("last_visit") - 5000).alias("first_visit"), "last_visit", "visit_count", (F.col("seq") % 130).alias("active_seconds"), F.lit(None).cast("string").alias("cluster_id"))


def _captures(spark, d):
    p = table(spark, d, "pages")
    return p.select((F.col("page_id") * 2).cast("string").alias("id"), "url", F.lit("captured").alias("title"), F.lit("some  text").alias("text"), F.lit(2).alias("extraction_tier"), (F.lit(T0) + 10**9 + F.col("page_id")).alias("captured_at"), (F.lit(T0) + F.col("page_id")).alias("queued_at"), F.lit(7).cast("long").alias("active_seconds"))


def merge_pages(spark, d):
    pages = page_rows(spark, d)
    return store.upsert(pages, store.merge_captures(pages, _captures(spark, d))).select("id", "title", "first_visit", "last_visit", "visit_count", "active_seconds")


def drain_queue(spark, d):
    """What remains queued after one drain."""
    return capture.drain(page_rows(spark, d), _captures(spark, d), 20)[1].select("id", "queued_at")


def delete_pages(spark, d):
    return store.delete_range(page_rows(spark, d), T0 + 20 * 137_000, T0 + 40 * 137_000).select("id", "last_visit")


def export_pages(spark, d):
    return store.export_rows(page_rows(spark, d)).select("url", "title", "format", "firstVisit", "lastVisit", "visitCount", "activeSeconds")


def export_lines(spark, d):
    return store.export_markdown(page_rows(spark, d)).select("id", "day", "heading", "line")


QUERIES = {f.__name__: f for f in (url_parts, normalize_url, url_identity, url_words, title_tails, title_checks, fold_visits, fold_per_visit, filter_pages, filter_audit, filter_reconcile, filter_samples, junk_titles, extraction, text_quality, preview_text, capture_gate, merge_pages, drain_queue, delete_pages, export_pages, export_lines)}

_TITLE = r"""trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'))"""
_HOST = r"regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\.', '')"
_PATH = r"coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/')"
_QUERY = r"regexp_extract(url, '(\?[^#]*)', 1)"
_VISITS = f"SELECT url, {_TITLE} AS title, {T0} + page_id * 137000 AS last_visit, 1 + page_id % 5 AS visit_count, page_id % 3 AS typed_count, page_id AS seq FROM pages"
_TIDY = r"trim(regexp_replace(regexp_replace(title, '^\(\d+\)\s*', ''), '\s+', ' ', 'g'))"
_NORMAL = rf"""concat(regexp_extract(url, '^(https?)', 1), '://', {_HOST}, CASE WHEN length({_PATH}) > 1 THEN regexp_replace({_PATH}, '/$', '') ELSE '/' END,
  CASE WHEN length({_QUERY}) > 1 THEN coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(substr({_QUERY}, 2), '&'), lambda p: NOT regexp_matches(string_split(p, '=')[1], '(?i)^(utm_[a-z_]+|fbclid|gclid|ref_src|ref_url|si|spm|scm)$'))), '&'), ''), '') ELSE '' END)"""
_EVENTS = "SELECT 'https://' || event_type || '.example/' || user_id AS normalized_url, 'https://' || event_type || '.example/' || user_id || '?v=' || event_id AS url, event_type AS domain, CASE WHEN event_id % 3 = 0 THEN '' ELSE 't' || event_id END AS title, epoch_us(ts) // 1000 AS last_visit, 1 + event_id % 7 AS visit_count, event_id % 2 AS typed_count, event_id AS seq FROM events"
_PAGES = f"SELECT CAST(seq AS VARCHAR) AS id, url, title, 'other' AS format, last_visit - 5000 AS first_visit, last_visit, visit_count, seq % 130 AS active_seconds, seq FROM ({_VISITS})"
_FORMAT = rf"CASE WHEN regexp_matches({_PATH}, '(?i)^/(docs?|documentation|reference|api|guide|manual)(/|$)') THEN 'docs' WHEN regexp_matches({_PATH}, '(?i)^/(blog|posts?|articles?)(/|$)') THEN 'article' WHEN regexp_matches({_PATH}, '(?i)^/(watch|video|embed)(/|$)') THEN 'video' ELSE 'other' END"


def _any(value: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({value}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


_JUNK = f"(title = '' OR {_any('title', fixed.JUNK_EXACT)} OR {_any('title', fixed.JUNK_STRONG)} OR (length(title) <= 40 AND {_any('title', fixed.JUNK_PREFIX)}))"
# The chain over http pages: no other scheme, local or sensitive site occurs, titles are never bare URLs; one suffix pass suffices.
_FILTER = rf"""WITH v0 AS (SELECT *, {_NORMAL} AS normalized_url, {_HOST} AS domain, {_TIDY} AS tidy FROM ({_VISITS})),
v AS (SELECT url, tidy AS title, last_visit, visit_count, typed_count, seq, normalized_url, domain FROM v0),
r AS (SELECT *, coalesce(visit_count > max(visit_count) OVER (PARTITION BY normalized_url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS rec FROM v),
c AS (SELECT normalized_url, arg_max(url, seq) FILTER (rec) AS url, arg_min(domain, seq) AS domain, coalesce(arg_max(title, seq) FILTER (rec AND title <> ''), arg_min(title, seq) FILTER (title <> ''), '') AS title, max(last_visit) AS last_visit, max(visit_count) AS visit_count, max(typed_count) AS typed_count, count(*) AS rows FROM r GROUP BY 1),
p AS (SELECT *, string_split_regex(title, '\s+[|–—·•:»~\-]\s+') AS parts FROM c),
t AS (SELECT lower(trim(list_last(parts))) AS tail FROM p WHERE len(parts) > 1 AND length(trim(list_last(parts))) BETWEEN 1 AND 40 GROUP BY 1 HAVING count(*) >= greatest(5, floor((SELECT count(*) FROM c) * 0.003 + 0.5))),
j AS (SELECT *, CASE WHEN len(parts) > 1 AND lower(trim(list_last(parts))) IN (SELECT tail FROM t) AND length(trim(array_to_string(parts[:-2], ' - '))) >= 8 THEN trim(array_to_string(parts[:-2], ' - ')) ELSE title END AS embed_text, {_JUNK} AS junk FROM p),
k AS (SELECT *, CASE WHEN junk THEN 'junk-title' WHEN length(embed_text) < 15 THEN 'short-title' END AS reason FROM j),
d AS (SELECT 'duplicate' AS reason, domain AS key, CAST(sum(rows - 1) AS BIGINT) AS n, 'rows' AS unit FROM c WHERE rows > 1 GROUP BY 2 UNION ALL SELECT reason, title, count(*), 'pages' FROM k WHERE reason IS NOT NULL GROUP BY 1, 2)
"""

SQL = {
    "filter_pages": _FILTER + "SELECT normalized_url, url, domain, title, embed_text, FALSE AS path_rescued, last_visit, visit_count, typed_count FROM k WHERE reason IS NULL",
    "filter_audit": _FILTER + "SELECT * FROM d",
    "filter_samples": _FILTER + "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY reason ORDER BY n DESC, key) AS INT) AS rank FROM d) WHERE rank <= 200",
    "filter_reconcile": _FILTER + "SELECT " + ", ".join(f"CAST(coalesce(sum(n) FILTER (reason = '{x}'), 0) AS BIGINT) AS {x.replace('-', '_')}" for x in filtering.UNITS) + ", (SELECT count(*) FROM pages) AS raw, (SELECT count(*) FROM k WHERE reason IS NULL) AS kept, CAST(0 AS BIGINT) AS unaccounted, TRUE AS reconciles FROM d",
    "junk_titles": _FILTER + "SELECT title, count(*) AS n FROM k WHERE reason = 'junk-title' GROUP BY 1",
    "url_parts": rf"SELECT page_id, {_HOST} AS domain, {_PATH} AS path, {_QUERY} AS query, regexp_extract(url, '(#.*)$', 1) AS fragment, FALSE AS is_local, {_FORMAT} AS format FROM pages",
    "normalize_url": f"SELECT page_id, {_NORMAL} AS normalized_url FROM pages",
    "url_identity": rf"""WITH n AS (SELECT page_id, url, {_QUERY} AS q, {_PATH} AS p, regexp_extract(url, '(#.*)$', 1) AS f, list_transform(string_split({_NORMAL}, ''), lambda c: CAST(unicode(c) AS HUGEINT)) AS c FROM pages)
SELECT page_id, printf('%08x', CAST(list_reduce(c, lambda h, x: (xor(h, x) * 16777619) % 4294967296, CAST(2166136261 AS HUGEINT)) AS BIGINT)) || printf('%08x', CAST(list_reduce(c, lambda h, x: (xor(h, x) * 2246822507) % 4294967296, CAST(16777619 AS HUGEINT)) AS BIGINT)) AS id,
q AS stable, p || q || CASE WHEN starts_with(f, '#/') THEN f ELSE '' END AS navigation, FALSE AS is_search, 'none' AS category, '/_favicon/?pageUrl=' || url_encode(url) || '&size=32' AS favicon FROM n""",
    "url_words": rf"""WITH h AS (SELECT page_id, {_HOST} AS bare, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host, {_PATH} || ' ' || {_QUERY} AS rest FROM pages),
s AS (SELECT page_id, string_split_regex(host, '[.-]') AS labels, list_filter(string_split_regex(host || ' ' || rest, '[/\-_.?&=#%,:;()\[\]\s]+'), lambda w: length(w) >= 3 AND regexp_matches(w, '(?i)[a-z]') AND NOT regexp_matches(w, '(?i)^[a-f0-9]{{8,}}$') AND NOT (length(w) >= 10 AND regexp_matches(w, '[0-9]') AND NOT regexp_matches(w, '(?i)[aeiou]')) AND NOT list_contains(string_split('{fixed.PATH_STOPWORDS}', ' '), lower(w))) AS w FROM h),
x AS (SELECT page_id, labels, w[i] AS word, i FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM s) WHERE list_position(list_transform(w, lambda y: lower(y)), lower(w[i])) = i),
p AS (SELECT page_id, i, list_contains(labels, lower(word)) AS own, unnest(string_split(regexp_replace(word, '([a-z])([A-Z])', '\1 \2', 'g'), ' ')) AS piece FROM x)
SELECT h.page_id, coalesce(string_agg(lower(piece), ' ' ORDER BY i) FILTER (length(piece) >= 3), '') AS words, count(*) FILTER (length(piece) >= 3 AND NOT own) >= 2 AS usable FROM h LEFT JOIN p USING (page_id) GROUP BY 1""",
    "title_tails": rf"""SELECT tail, count(*) AS n FROM (SELECT lower(trim(list_last(p))) AS tail FROM (SELECT string_split_regex({_TIDY}, '\s+[|–—·•:»~\-]\s+') AS p FROM ({_VISITS})) WHERE len(p) > 1 AND length(trim(list_last(p))) BETWEEN 1 AND 40) GROUP BY tail""",
    "fold_visits": f"""WITH v AS ({_EVENTS}), r AS (SELECT *, coalesce(visit_count > max(visit_count) OVER (PARTITION BY normalized_url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS rec FROM v)
SELECT normalized_url, arg_max(url, seq) FILTER (rec) AS url, arg_min(domain, seq) AS domain, coalesce(arg_max(title, seq) FILTER (rec AND title <> ''), arg_min(title, seq) FILTER (title <> ''), '') AS title, max(last_visit) AS last_visit, max(visit_count) AS visit_count, max(typed_count) AS typed_count, count(*) AS rows, min(seq) AS seq FROM r GROUP BY normalized_url""",
    "fold_per_visit": f"""WITH v AS ({_EVENTS})
SELECT normalized_url, arg_min(url, seq) AS url, arg_min(domain, seq) AS domain, coalesce(arg_min(title, seq) FILTER (title <> ''), '') AS title, max(last_visit) AS last_visit, arg_min(visit_count, seq) + count(*) - 1 AS visit_count, max(typed_count) AS typed_count, count(*) AS rows, min(seq) AS seq FROM v GROUP BY normalized_url""",
    "title_checks": rf"""SELECT page_id, title, CAST(length(title) AS BIGINT) AS units, length(title) >= 30 AND regexp_matches(title, '^[!-~]+$') AS bare, title = '' OR regexp_matches(title, '(?i)^(new tab|untitled|home|index|dashboard|welcome|error)$') OR NOT regexp_matches(title, '[\p{{L}}\p{{N}}]') AS junk FROM (SELECT seq AS page_id, {_TIDY} AS title FROM ({_VISITS}))""",
    "export_lines": f"""WITH p AS (SELECT *, ((last_visit - 14400000) // 86400000) * 86400000 + 14400000 AS day, {_FORMAT} AS fmt FROM ({_PAGES}))
SELECT id, day, CASE WHEN row_number() OVER (PARTITION BY day ORDER BY last_visit DESC, id) = 1 THEN '## ' || strftime(make_timestamp(day * 1000), '%A, %B %-d, %Y') END AS heading,
'- [' || CASE WHEN title = '' THEN url ELSE title END || '](' || url || ') — ' || concat_ws(' · ', fmt, CASE WHEN visit_count > 1 THEN visit_count || '×' END, CASE WHEN active_seconds > 0 THEN CASE WHEN active_seconds < 60 THEN active_seconds || 's' ELSE CAST(floor(active_seconds / 60.0 + 0.5) AS INT) || 'm' END END) AS line FROM p""",
    "text_quality": f"""WITH a AS (SELECT doc_id, n_chars, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents),
b AS (SELECT *, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}'']+') AS w, len(regexp_extract_all(t, '{fixed.TERMINATOR}')) AS ends FROM a),
c AS (SELECT *, list_distinct(w) AS uq, len(w) AS units, left(t, 2000) AS s FROM b),
e AS (SELECT *, CASE WHEN length(s) > 0 AND len(regexp_extract_all(s, '[A-Za-z]')) / length(s) > 0.3 THEN CASE WHEN len(uq) > 0 THEN len(list_intersect(uq, string_split('{fixed.PROSE_STOPWORDS}', ' '))) / len(uq) ELSE 0 END END AS ratio, CASE WHEN units > 0 THEN ends / units * 100 ELSE 0 END AS per FROM c),
f AS (SELECT *, round((0.35::DOUBLE * least(1, units / 250) + CASE WHEN ratio IS NULL THEN 0 ELSE 0.4::DOUBLE * least(1, ratio / 0.3::DOUBLE) END + 0.25::DOUBLE * least(1, per / 4)) / (0.6::DOUBLE + CASE WHEN ratio IS NULL THEN 0 ELSE 0.4::DOUBLE END), 3) AS score FROM e)
SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, round(CASE WHEN n_chars > 0 THEN least(1, length(t) / (n_chars * 2)) ELSE 0 END, 3) AS coverage, round(ratio, 3) AS stopword_ratio, round(per, 1) AS terminators_per_100, round(CASE WHEN len(w) > 0 THEN len(uq) / len(w) ELSE 0 END, 3) AS type_token_ratio, CAST(units AS BIGINT) AS units, score,
CASE WHEN (units >= 115 AND ends = 0) OR units < 65 OR score < 0.35 THEN 'poor' WHEN score < 0.6 THEN 'weak' ELSE 'good' END AS verdict FROM f""",
    "capture_gate": f"SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'incognito' WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' ELSE 'accepted' END AS reason FROM pages",
    "preview_text": r"""SELECT doc_id, CASE WHEN length(f) <= 160 THEN f WHEN contains(left(f, 160), ' ') AND 160 - strpos(reverse(left(f, 160)), ' ') > 144 THEN left(left(f, 160), 160 - strpos(reverse(left(f, 160)), ' ')::INT) ELSE left(f, 160) END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)""",
    "merge_pages": f"""WITH p AS ({_PAGES}), c AS (SELECT CAST(page_id * 2 AS VARCHAR) AS id, {T0} + 1000000000 + page_id AS captured_at FROM pages)
SELECT p.id, p.title, first_visit, last_visit, visit_count, active_seconds FROM p ANTI JOIN c USING (id)
UNION ALL SELECT c.id, 'captured', coalesce(p.first_visit, captured_at), captured_at, coalesce(p.visit_count, 0) + 1, coalesce(p.active_seconds, 0) + 7 FROM c LEFT JOIN p USING (id)""",
    "drain_queue": f"SELECT CAST(page_id * 2 AS VARCHAR) AS id, {T0} + page_id AS queued_at FROM pages ORDER BY page_id OFFSET 20",
    "delete_pages": f"SELECT CAST(page_id AS VARCHAR) AS id, {T0} + page_id * 137000 AS last_visit FROM pages WHERE page_id NOT BETWEEN 20 AND 40",
    "export_pages": f"""SELECT url, title, {_FORMAT} AS format, strftime(make_timestamp((last_visit - 5000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS firstVisit, strftime(make_timestamp(last_visit * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS lastVisit, visit_count AS visitCount, active_seconds AS activeSeconds FROM ({_PAGES})""",
}
