"""Raw visits to pages: the ordered drop chain, the keyed fold, and the audit.

The first rule that holds owns a row's drop, so the chain is one column and not a row of filters, and
every row is accounted for. The fold over rows of one page is map-side aggregation throughout; what
needs an order (which row set a new record) is decided on one row for each visit count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.functions import fixed, text, urls
from pagestrata.session import checkpointed

UNITS = {"no-url": "rows", "scheme": "rows", "localhost": "rows", "blocked": "rows", "search": "rows", "duplicate": "rows", "junk-title": "pages", "short-title": "pages"}


@dataclass
class Filtered:
    """``pages``: the survivors; ``judged``: candidates with their second-pass verdict; ``drops``: (reason, key, n, unit); ``raw``: the tagged rows."""

    pages: DataFrame
    judged: DataFrame
    drops: DataFrame
    raw: DataFrame
    suffixes: list[str]


def first_pass(visits: DataFrame, categories: tuple[str, ...] = fixed.CATEGORIES) -> DataFrame:
    """Adds u (parsed URL), reason and key; a null reason goes on."""
    rows = visits.withColumn("u", urls.parts(F.col("url"))).withColumn("site", urls.domain(F.col("u")))
    u = F.col("u")
    # Sites are looked up only where a category is blocked at all.
    blocked = F.coalesce(urls.sensitive(u).isin(*categories), F.lit(False)) if categories else F.lit(False)
    rules = [
        ("no-url", F.coalesce(F.col("url"), F.lit("")) == "", F.lit("(empty)")),
        ("no-url", u.isNull(), F.substring("url", 1, 80)),
        ("scheme", ~u["scheme"].isin("http", "https"), F.concat(u["scheme"], F.lit(":"))),
        ("localhost", urls.is_local(u["host"]), u["host"]),
        ("blocked", blocked, F.col("site")),
        ("search", urls.is_search_page(u), F.col("site")),
    ]
    reason = key = F.lit(None).cast("string")
    for name, holds, what in reversed(rules):
        reason, key = F.when(holds, name).otherwise(reason), F.when(holds, what).otherwise(key)
    return rows.withColumn("dropped", F.struct(reason.alias("reason"), key.alias("key"))).select("*", "dropped.reason", "dropped.key").drop("dropped")


def fold(rows: DataFrame, per_visit: bool) -> DataFrame:
    """One row for each normalized_url of (normalized_url, url, domain, title, last_visit, visit_count, typed_count, seq)."""
    by = "normalized_url"
    folded = rows.groupBy(by).agg(
        F.count("*").alias("rows"), F.min_by("domain", "seq").alias("domain"), F.min_by("url", "seq").alias("first_url"), F.min_by("visit_count", "seq").alias("first_count"),
        F.min_by("url", F.struct(-F.col("visit_count"), F.col("seq"))).alias("best_url"), F.max("visit_count").alias("best_count"),
        F.expr("min_by(title, seq) FILTER (WHERE title <> '')").alias("first_title"), F.max("last_visit").alias("last_visit"), F.max("typed_count").alias("typed_count"), F.min("seq").alias("seq"))
    if per_visit:
        return folded.select(by, F.col("first_url").alias("url"), "domain", F.coalesce("first_title", F.lit("")).alias("title"), "last_visit", (F.col("first_count") + F.col("rows") - 1).alias("visit_count"), "typed_count", "rows", "seq")
    # A row sets a record if no earlier one counts as many visits; the last titled record names the page.
    counts = rows.groupBy(by, "visit_count").agg(F.min(F.struct("seq", "title")).alias("m"))
    earlier = F.min("m.seq").over(Window.partitionBy(by).orderBy(F.desc("visit_count")).rowsBetween(Window.unboundedPreceding, -1))
    named = counts.withColumn("higher", earlier).where("(higher IS NULL OR m.seq < higher) AND m.title <> ''").groupBy(by).agg(F.max_by("m.title", "visit_count").alias("record_title"))
    return folded.join(named, by, "left").select(by, F.col("best_url").alias("url"), "domain", F.coalesce("record_title", "first_title", F.lit("")).alias("title"), "last_visit", F.col("best_count").alias("visit_count"), "typed_count", "rows", "seq")


def boilerplate(candidates: DataFrame, share: float = 0.003, least: int = 5) -> DataFrame:
    """(tail, n): title endings that at least ``least`` and about ``share`` of all titles have."""
    n = candidates.count()
    most = max(least, int(share * n + 0.5))
    return candidates.select(text.tail(F.col("title")).alias("tail")).where("tail IS NOT NULL").groupBy("tail").agg(F.count("*").alias("n")).where(F.col("n") >= most)


def second_pass(candidates: DataFrame, suffixes: list[str], strip: bool = True) -> DataFrame:
    """Adds embed_text, path_rescued, reason and key."""
    title = F.col("title")
    known = F.array(*map(F.lit, suffixes)) if suffixes else F.array().cast("array<string>")
    rows = candidates.withColumn("stripped", text.strip_suffix(title, known) if strip and suffixes else title).withColumn("bare", text.is_bare_url(title))
    rows = rows.withColumn("words", F.when(F.col("bare"), urls.path_words(F.col("url"))))
    rescued = F.col("bare") & (F.size("words.path_only") >= 2)
    junk = text.is_junk(title, title) | text.is_junk(F.col("stripped"), title)
    short = text.utf16_length(F.col("stripped")) < text.MIN_TITLE
    reason = F.when(rescued, None).when(F.col("bare") | junk, "junk-title").when(short, "short-title")
    return rows.withColumn("path_rescued", rescued).withColumn("embed_text", F.when(rescued, F.array_join("words.words", " ")).otherwise(F.col("stripped"))).withColumn("reason", reason).withColumn("key", title).drop("stripped", "bare", "words")


def filter_visits(visits: DataFrame, per_visit: bool = False, strip: bool = True, categories: tuple[str, ...] = fixed.CATEGORIES) -> Filtered:
    """``visits``: url, title, last_visit (ms), visit_count and typed_count (may be null), seq (input order)."""
    raw = first_pass(visits, categories)
    rows = raw.where("reason IS NULL").select(
        urls.normalize(F.col("u")).alias("normalized_url"), "url", F.col("site").alias("domain"), text.tidy(F.col("title")).alias("title"), "last_visit",
        F.coalesce("visit_count", F.lit(1)).alias("visit_count"), F.coalesce("typed_count", F.lit(0)).alias("typed_count"), "seq")
    # Written once: the suffixes, the verdicts and the audit all read it, and none repeats the first pass over raw rows.
    candidates = checkpointed(visits.sparkSession, fold(rows, per_visit))
    # A suffix has at least 0.3 % of all titles, so there are at most 333 of them.
    suffixes = sorted(r.tail for r in boilerplate(candidates).collect()) if strip else []
    judged = second_pass(candidates, suffixes, strip)
    drops = raw.where("reason IS NOT NULL").groupBy("reason", "key").agg(F.count("*").alias("n"))
    drops = drops.unionByName(candidates.where("rows > 1").groupBy(F.lit("duplicate").alias("reason"), F.col("domain").alias("key")).agg(F.sum(F.col("rows") - 1).alias("n")))
    drops = drops.unionByName(judged.where("reason IS NOT NULL").groupBy("reason", "key").agg(F.count("*").alias("n")))
    units = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    pages = judged.where("reason IS NULL").drop("reason", "key", "rows")
    return Filtered(pages, judged, drops.withColumn("unit", units[F.col("reason")]), raw, suffixes)


def reconcile(found: Filtered) -> DataFrame:
    """One row: raw, kept, a column for each reason, unaccounted, reconciles."""
    sums = found.drops.groupBy().pivot("reason", list(UNITS)).agg(F.sum("n"))
    sums = sums.select(*(F.coalesce(F.col(f"`{r}`"), F.lit(0)).alias(r.replace("-", "_")) for r in UNITS))
    total: Column = sum((F.col(r.replace("-", "_")) for r in UNITS), F.lit(0))
    one = sums.join(found.raw.agg(F.count("*").alias("raw")), how="full").join(found.pages.agg(F.count("*").alias("kept")), how="full")
    return one.withColumn("unaccounted", F.col("raw") - F.col("kept") - total).withColumn("reconciles", F.col("unaccounted") == 0)


def samples(found: Filtered, most: int = 200) -> DataFrame:
    """The most frequent keys of each reason: a top-k report."""
    rank = F.row_number().over(Window.partitionBy("reason").orderBy(F.desc("n"), "key"))
    return found.drops.withColumn("rank", rank).where(F.col("rank") <= most)
