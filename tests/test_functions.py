"""Functions on hand-derived cases."""

import pytest
from pyspark.sql import functions as F

from pagestrata.functions import text, times, urls, vectors


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first().r


def parsed(f):
    return lambda c: f(urls.parts(c))


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://User:pw@WWW.Example.com:443/a/?utm_source=x&b=2&a=1#f", "https://example.com/a?a=1&b=2"),
        ("http://ex.com/", "http://ex.com/"),
        ("http://ex.com", "http://ex.com/"),
        ("http://ex.com:8080/a//", "http://ex.com:8080/a/"),
        ("http://ex.com/x?page=2&ref=x", "http://ex.com/x?page=2&ref=x"),
        ("http://ex.com/x?a=b+c&a=%C3%A9", "http://ex.com/x?a=b+c&a=%C3%A9"),
        ("not a url", None),
        ("", None),
        (None, None),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, url, parsed(urls.normalize)) == want


@pytest.mark.parametrize(("query", "want"), [("?v=abc&t=10s&pp=xx", "?v=abc"), ("?t=1", ""), ("", "")])
def test_stable_search(spark, query, want):
    assert one(spark, query, urls.stable_search) == want


@pytest.mark.parametrize(("host", "want"), [("172.16.0.1", True), ("172.15.0.1", False), ("my.local", True), ("localhost", True), ("example.com", False), ("[::1]", True)])
def test_local(spark, host, want):
    assert one(spark, host, urls.is_local) is want


@pytest.mark.parametrize(("url", "want"), [("https://google.com/", True), ("https://google.com/maps/place/x", False), ("https://site.com/search?q=x", True), ("https://site.com/search", False), ("https://www.bing.com/search?q=a", True)])
def test_search_page(spark, url, want):
    assert one(spark, url, parsed(urls.is_search_page)) is want


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://netbanking.anybank.com/", "banking"), ("https://stripe.com/dashboard/x", "banking"), ("https://stripe.com/docs", None), ("https://okta.com/", "corporate"), ("https://sso.somesite.com/", None), ("https://mail.google.com/x", "email"), ("https://notchase.com/", None), ("https://x.irs.gov/", "government-id")],
)
def test_sensitive(spark, url, want):
    assert one(spark, url, parsed(urls.sensitive)) == want


@pytest.mark.parametrize(("url", "want"), [("https://docs.python.org/3/", "docs"), ("https://example.com/blog/x", "article"), ("https://youtu.be/x", "video"), ("https://netflix.com/", "other"), ("nope", "other")])
def test_format(spark, url, want):
    assert one(spark, url, parsed(urls.page_format)) == want


def test_path_words(spark):
    r = one(spark, "cf.legacypoint.site/middle.html?cs=1", urls.path_words)
    assert (r.words, r.path_only) == (["legacypoint", "middle"], ["middle"])
    r = one(spark, "https://a.com/someTopic/deep-dive/someTopic/12345", urls.path_words)
    assert r.path_only == ["some", "topic", "deep", "dive"]


def mul(a, b):
    return (a * b) & 0xFFFFFFFF


def plain_hash(s):
    units = s.encode("utf-16-be")
    h1, h2 = 0x811C9DC5, 0x01000193
    for i in range(0, len(units), 2):
        c = units[i] << 8 | units[i + 1]
        h1, h2 = mul(h1 ^ c, 0x01000193), mul(h2 ^ c, 0x85EBCA6B)
    return f"{h1:08x}{h2:08x}"


@pytest.mark.parametrize("s", ["https://example.com/a", "", "é😀", "x" * 100])
def test_hash_id(spark, s):
    assert one(spark, s, urls.hash_id) == plain_hash(s)
    assert plain_hash("https://example.com/a") == "0176574f751600e9"


@pytest.mark.parametrize(("title", "original", "want"), [("Sign in", "Sign in", True), ("Dashboard", "Dashboard | Google Skills", False), ("Error 404 (Not Found)", "Error 404 (Not Found)", True), ("Error handling with Result types and how they compose ok", "", False), ("", "", True)])
def test_junk(spark, title, original, want):
    assert spark.createDataFrame([(title, original)], "t string, o string").select(text.is_junk(F.col("t"), F.col("o")).alias("r")).first().r is want


def test_bare_url(spark):
    assert one(spark, "owner/repository-name-here-long", text.is_bare_url) is False
    assert one(spark, "https://example.com/a/b/c/d/e/f/g", text.is_bare_url) is True


def test_strip_suffix(spark):
    known = F.array(F.lit("reddit"), F.lit("r/docker"))
    assert one(spark, "Some Long Post - r/docker - Reddit", lambda c: text.strip_suffix(c, known)) == "Some Long Post"
    assert one(spark, "Short - Reddit", lambda c: text.strip_suffix(c, known)) == "Short - Reddit"
    assert one(spark, "(3)  a \t b ", text.tidy) == "a b"


@pytest.mark.parametrize(("s", "want"), [("Don't panic 2026", ["don't", "panic"]), ("機械学習", ["機械", "械学", "学習"]), ("機械学", ["機械学"]), ("", []), (None, [])])
def test_terms(spark, s, want):
    assert one(spark, s, text.terms) == want


def test_phrases(spark):
    r = one(spark, "the cat sat", lambda c: text.phrases(text.terms(c)))
    assert r == ["the", "cat", "sat", "cat sat"]


def test_cap(spark):
    assert one(spark, "ab  cd", text.cap) == "ab cd"
    assert one(spark, "aaaa bbbb cc", lambda c: text.cap(c, 10)) == "aaaa bbbb "[:10]
    assert one(spark, "aaaa bbbbb cc", lambda c: text.cap(c, 11)) == "aaaa bbbbb"
    assert one(spark, "a" * 20, lambda c: text.cap(c, 10)) == "a" * 10


def test_quality(spark):
    q = one(spark, "", lambda c: text.quality(c, F.lit(10)))
    assert (q.units, q.stopword_ratio, q.score, q.verdict) == (0, None, 0.0, "poor")
    q = one(spark, "The cat is in the house and it has a good time with all of us. " * 20, lambda c: text.quality(c, F.lit(10_000)))
    assert q.verdict == "good"


@pytest.mark.parametrize(("ms", "want"), [(1704081599000, 1703995200000 + 0), (1704081600000, 1704081600000)])
def test_day_start(spark, ms, want):
    got = spark.range(1).select(times.day_start(F.lit(ms)).alias("r")).first().r
    assert got == (1703995200000 if ms < 1704081600000 else want)


def test_times(spark):
    row = spark.range(1).select(
        times.week_start(F.lit(1704585600000)).alias("week"), times.webkit_to_unix(F.lit(13350000000000000)).alias("webkit"), times.webkit_to_unix(F.lit(0)).alias("zero"),
        times.remaining(F.lit(61_000)).alias("a"), times.remaining(F.lit(3_660_000)).alias("b"), times.remaining(F.lit(7_200_000)).alias("c"),
        times.opacity(F.lit(0.3)).alias("o1"), times.opacity(F.lit(0.625)).alias("o2"), times.opacity(F.lit(2.0)).alias("o3"),
        times.time_range(F.lit(1704150000000), F.lit(1704160800000)).alias("span"), times.is_paused(F.lit(5), F.lit(False), F.lit(5)).alias("p")).first()
    assert (row.week, row.webkit, row.zero) == (1704067200000, 1705526400000, 0)
    assert (row.a, row.b, row.c) == ("2 min", "1h 1m", "2h")
    assert (round(row.o1, 9), round(row.o2, 9), round(row.o3, 9)) == (0.55, 0.775, 1.0)
    assert row.span == "11:00pm–2:00am (next day)"
    assert row.p is False


def test_vectors(spark):
    row = spark.range(1).select(vectors.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), vectors.unit(F.array(F.lit(0.0))).alias("z"), vectors.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0))).alias("c")).first()
    assert (row.u, row.z, row.c) == ([0.6, 0.8], [0.0], None)


def test_ladder_judges_once(spark, data):
    """A page's length and the qualities of its candidates stand once in the plan, not wherever they are looked at."""
    from pagestrata.functions import fixed, text
    from pagestrata.plans import pages

    plan = pages.extraction(spark, data)._jdf.queryExecution().analyzed().toString()
    assert plan.count(fixed.TERMINATOR) == 2  # of candidates, and of the empty text where there are none
    assert plan.count(r"<(script|style)") == 1 + 1 + 3  # the whole page, the article, title and descriptions
    rows = spark.createDataFrame([("one two  three", 7), ("one two", 7), ("abcdefghij k", 10), (None, 3)], "t string, n int")
    assert [r[0] for r in rows.select(text.cap(rows.t, 7)).collect()] == ["one two", "one two", "abcdefg", ""]
