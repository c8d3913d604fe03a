"""Exact top-k by cosine with filters before ranking and a cap for each domain; lexical and hybrid ranking."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.functions import text, vectors
from pagestrata.operators import store
from pagestrata.session import checkpointed

POOL, DOMAIN_CAP, QUERY_CHARS = 6, 3, 512


@dataclass(frozen=True)
class Filters:
    start_time: int | None = None
    end_time: int | None = None
    format: str | None = None
    topic: str | None = None
    domain: str | None = None

    @classmethod
    def parse(cls, start: str = "", end: str = "", format: str = "", topic: str = "", domain: str = "") -> Filters:
        """From form fields; blank or unreadable means unset."""

        def number(s: str) -> int | None:
            try:
                return int(float(s)) if s.strip() else None
            except (ValueError, OverflowError):
                return None

        word = lambda s: s.strip() or None
        return cls(number(start), number(end), word(format), word(topic), word(domain))

    def column(self) -> Column:
        out = F.lit(True)
        if self.start_time is not None:
            out &= F.col("last_visit") >= self.start_time
        if self.end_time is not None:
            out &= F.col("last_visit") <= self.end_time
        if self.format is not None:
            out &= F.col("format") == self.format
        if self.topic is not None:
            out &= F.col("cluster_id") == self.topic
        if self.domain is not None:
            out &= F.contains(F.lower("domain"), F.lit(self.domain.lower()))
        return out


def search_index(pages: DataFrame, groups: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """What search ranks: representatives (pages in no group represent themselves), with group size, topic and preview."""
    if groups is not None:
        sizes = groups.groupBy("group").agg(F.count("*").alias("collapsed"), F.min_by("id", "pos").alias("id"))
        pages = pages.join(groups.where("pos > 0").select("id"), "id", "left_anti").join(sizes.select("id", "collapsed"), "id", "left")
    else:
        pages = pages.withColumn("collapsed", F.lit(1))
    pages = pages.withColumn("collapsed", F.coalesce("collapsed", F.lit(1)))
    if clusters is not None:
        pages = pages.join(clusters, "cluster_id", "left")
    has_text = F.length(F.coalesce("text", F.lit(""))) > 0
    return pages.withColumn("preview", text.cap(F.when(has_text, F.col("text")).otherwise(F.col("title")), text.PREVIEW)).withColumn("captured", has_text)


class StoredIndex:
    """The search index of a stored page table, kept by the executors until the table has a newer version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._version: int | None = None
        self._rows: DataFrame | None = None

    def rows(self) -> DataFrame | None:
        """The index of the latest version; None of a table without one."""
        found = store.versions(self.spark, self.path)
        if found and found[-1] != self._version:
            self.drop()
            self._rows, self._version = search_index(store.load(self.spark, self.path)).persist(), found[-1]
        return self._rows

    def drop(self) -> None:
        """Frees the rows; the next call reads the table anew."""
        if self._rows is not None:
            self._rows.unpersist()
        self._rows = self._version = None


def top_k(rows: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k rows of (id, x, ...) with the highest products with ``query``; ties to the smaller id. Each task keeps k."""
    rows = rows if where is None else rows.where(where)
    return rows.withColumn("score", vectors.dot(F.col("x"), F.array(*(F.lit(float(v)) for v in query)))).orderBy(F.desc("score"), "id").limit(k)


def diversify(found: DataFrame, limit: int, cap: int = DOMAIN_CAP) -> DataFrame:
    """Up to ``cap`` a domain in score order, then what is over, up to ``limit``; ``found`` is a bounded pool."""
    nth = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("score"), "id"))
    over = found.withColumn("_over", nth > cap)
    return over.orderBy("_over", F.desc("score"), "id").limit(limit).drop("_over").orderBy(F.desc("score"), "id")


def search(index: DataFrame, query: list[float], limit: int = 20, filters: Filters = Filters()) -> DataFrame:
    return diversify(top_k(index, query, limit * POOL, filters.column()), limit)


def more_like(index: DataFrame, page_id: int, limit: int = 20) -> DataFrame:
    """Neighbours of a page without itself; none if there is no such page."""
    seed = index.where(F.col("id") == page_id).select("x").first()
    if seed is None:
        return index.withColumn("score", F.lit(0.0)).limit(0)
    return diversify(top_k(index, list(seed.x), limit * POOL, F.col("id") != page_id), limit)


def bm25(docs: DataFrame, query: str | list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, bm25): of (id, title), for documents that hold a query term; repeated query terms count each time.

    One pass over the texts keeps of each its number of terms and those of the query; all else reads that small table.
    """
    spark = docs.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(text.terms(F.col("q")))).collect() if isinstance(query, str) else [(w,) for w in query]
    times = Counter(w for (w,) in asked)
    if not times:
        return docs.select("id", F.lit(0.0).alias("bm25")).where("false")
    wanted = F.array(*map(F.lit, sorted(times)))
    rows = docs.select("id", text.let(text.terms(F.col("title")), lambda t: F.struct(F.size(t).alias("len"), F.filter(t, lambda w: F.array_contains(wanted, w)).alias("held"))).alias("t"))
    rows = checkpointed(spark, rows.select("id", "t.*"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    tf = rows.select("id", "len", F.explode("held").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("f"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    met = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))  # the query's terms, and one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    often = F.create_map(*(F.lit(x) for pair in sorted(times.items()) for x in pair))[F.col("term")]
    score = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / F.col("mean"))) * often
    return met.groupBy("id").agg(F.sum(score).alias("bm25"))


def hybrid(index: DataFrame, query: list[float], words: str, k: int = 5, weight: float = 0.5) -> DataFrame:
    """Half cosine, half BM25, each scaled to 0..1 over all rows; the extremes are one aggregate, no window over everything."""
    rows = index.withColumn("cosine", vectors.dot(F.col("x"), F.array(*(F.lit(float(v)) for v in query)))).join(bm25(index, words), "id", "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    ends = rows.agg(*(f(c).alias(f"{n}_{c}") for c in ("cosine", "bm25") for n, f in (("lo", F.min), ("hi", F.max))))
    met = rows.join(F.broadcast(ends))
    scaled = {c: vectors.min_max(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in ("cosine", "bm25")}
    return met.withColumn("score", weight * scaled["cosine"] + (1 - weight) * scaled["bm25"]).orderBy(F.desc("score"), "id").limit(k).drop(*ends.columns)


def score_shape(scored: DataFrame, by: str = "query") -> DataFrame:
    """Per query of (query, id, score): best score, gaps to the second and the fifth, deviation of the best 20."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    top = scored.withColumn("rank", rank).where("rank <= 20")
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return top.groupBy(by).agg(at(1).alias("top1"), (at(1) - at(2)).alias("gap12"), (at(1) - at(5)).alias("gap15"), F.stddev_pop("score").alias("sd20"))
