"""The whole way from raw visits to a searchable, named corpus, and queries by text on it."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions import embed, fixed, text, urls
from pagestrata.operators import filtering, labels, search, vectors
from pagestrata.plans.pages import visits
from pagestrata.session import checkpointed, single_flight

STAGES = ("filter", "embed", "collapse", "cluster", "label")


class Cancelled(Exception):
    """Raised between stages when the caller asks to stop; no summary exists then."""


@dataclass
class Corpus:
    pages: DataFrame
    groups: DataFrame
    members: DataFrame
    clusters: DataFrame
    nodes: DataFrame
    found: filtering.Filtered
    stage_ms: dict[str, int] = field(default_factory=dict)


def backfill(spark: SparkSession, rows: DataFrame, encode: Callable | None = None, per_visit: bool = False, categories: tuple[str, ...] = fixed.CATEGORIES, threshold: float = 0.97, k: int = 10, shared: int = 4, floor: float = 0.2, least: int = 5, strip: bool = True, newest: int | None = None, clusterer: Callable[[SparkSession, DataFrame], DataFrame] | None = None, cancelled: Callable[[], bool] = lambda: False, progress: Callable[[str], None] = lambda stage: None) -> Corpus:
    """Filters, embeds, collapses, clusters and names visits. Each stage ends in a checkpoint, where it can be cancelled.

    ``newest`` keeps only so many of the latest pages. ``clusterer`` makes (id, cluster) of nodes (id, x) in another way than by shared neighbours.
    """
    took: dict[str, int] = {}
    encode = encode or embed.embedder()

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if cancelled():
            raise Cancelled(name)
        progress(name)
        began = time.time()
        out = checkpointed(spark, make())
        took[name] = int((time.time() - began) * 1000)
        return out

    found: list[filtering.Filtered] = []

    def kept() -> DataFrame:
        found.append(filtering.filter_visits(rows, per_visit, strip, categories))
        all_pages = found[0].pages.withColumn("key", urls.hash_id(F.col("normalized_url"))).withColumn("id", F.xxhash64("normalized_url"))
        return all_pages if newest is None else all_pages.orderBy(F.desc("last_visit"), "id").limit(newest)

    pages = stage("filter", kept)
    pages = stage("embed", lambda: pages.withColumn("x", encode(F.col("embed_text"))))
    groups = stage("collapse", lambda: vectors.collapse(spark, pages.select("id", "x", "visit_count", "title"), threshold))
    nodes = checkpointed(spark, vectors.centroids(groups.join(pages.select("id", "x"), "id"), "group").select(F.col("group").alias("id"), F.col("centroid").alias("x")))
    members = stage("cluster", lambda: clusterer(spark, nodes) if clusterer else vectors.cluster(spark, nodes, vectors.neighbours(nodes, k, floor), k, shared, floor, least))
    placed = groups.join(members.select(F.col("id").alias("group"), "cluster"), "group")
    titles = placed.where("cluster IS NOT NULL").join(pages.select("id", "embed_text"), "id").select(F.col("cluster").alias("class"), F.col("id").alias("title_id"), F.col("embed_text").alias("title"))
    clusters = stage("label", lambda: labels.label(titles).select(F.col("class").cast("string").alias("cluster_id"), "label"))
    pages = pages.join(placed.select("id", F.col("cluster").cast("string").alias("cluster_id")), "id", "left").withColumn("text", F.lit("")).withColumn("format", urls.page_format(urls.parts(F.col("url"))))
    return Corpus(pages, groups, placed, clusters, nodes, found[0], took)


def backfill_once(spark: SparkSession, rows: DataFrame, lock: str, progress: Callable[[str], None] = lambda stage: None, **options) -> Corpus:
    """backfill as the only one of its lock file; Busy while another runs. Every stage renews the lock."""
    with single_flight(spark, lock) as renew:

        def begun(stage: str) -> None:
            renew()
            progress(stage)

        return backfill(spark, rows, progress=begun, **options)


def summary(corpus: Corpus) -> DataFrame:
    """One row: pages, nodes, clusters, named clusters, noise in nodes and in pages."""
    m = corpus.members
    nodes = m.agg(F.count("*").alias("pages"), F.countDistinct("group").alias("nodes"), F.countDistinct("cluster").alias("clusters"), F.count_if(F.col("cluster").isNull()).alias("noise_pages"), F.count_if(F.col("cluster").isNull() & (F.col("pos") == 0)).alias("noise_nodes"))
    return nodes.join(F.broadcast(corpus.clusters.agg(F.count("label").alias("named"))))


@dataclass
class Answer:
    hits: list[Row]
    scanned: int
    timings: dict[str, int]


def answer(spark: SparkSession, corpus: Corpus, query: str, limit: int = 20, filters: search.Filters = search.Filters(), encode: Callable | None = None) -> Answer:
    """``ask`` with its at most ``limit`` hits fetched, the number of rows that the index holds, and what each part took in milliseconds."""
    clock = [time.perf_counter()]
    scanned = search.search_index(corpus.pages, corpus.groups, corpus.clusters).count()
    clock.append(time.perf_counter())
    found = ask(spark, corpus, query, limit, filters, encode)
    clock.append(time.perf_counter())
    hits = found.collect()
    clock.append(time.perf_counter())
    ms = lambda a, b: round((clock[b] - clock[a]) * 1000)
    return Answer(hits, scanned, {"load_ms": ms(0, 1), "embed_ms": ms(1, 2), "scan_ms": ms(2, 3), "total_ms": ms(0, 3)})


def ask(spark: SparkSession, corpus: Corpus, query: str, limit: int = 20, filters: search.Filters = search.Filters(), encode: Callable | None = None) -> DataFrame:
    """Search by text: the query, cut at 512 characters, is embedded as pages are."""
    x = spark.createDataFrame([(query[: search.QUERY_CHARS],)], "q string").select((encode or embed.embedder())(F.col("q")).alias("x")).first().x
    index = search.search_index(corpus.pages, corpus.groups, corpus.clusters)
    return search.search(index, list(x), limit, filters).select("id", "url", "title", "preview", "captured", "domain", "format", "last_visit", "collapsed", "visit_count", "cluster_id", "label", "score")


def _corpus(spark: SparkSession, d: str) -> Corpus:
    return backfill(spark, visits(spark, d), shared=2, least=2)


def backfill_summary(spark, d):
    return summary(_corpus(spark, d))


def backfill_pages(spark, d):
    return _corpus(spark, d).pages.select("key", "url", "title", "embed_text", "domain", "format", "cluster_id")


def ask_pages(spark, d):
    return ask(spark, _corpus(spark, d), "the thing that was there", 10).select("url", "title", "domain", "collapsed", "label", F.round("score", 6).alias("score"))


def embed_titles(spark, d):
    x = embed.embedder()(F.col("title"))
    return visits(spark, d).select("seq", text.tidy(F.col("title")).alias("title")).select("seq", F.size(x).alias("dim"))


QUERIES = {f.__name__: f for f in (backfill_summary, backfill_pages, ask_pages, embed_titles)}
SQL = {"embed_titles": "SELECT page_id AS seq, 64 AS dim FROM pages"}
