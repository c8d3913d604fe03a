"""Readers of visit logs in their several shapes; all give (url, title, last_visit ms, visit_count, typed_count, first_visit, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagestrata.functions import times

ITEM = "url string, title string, lastVisitTime double, last_visit_time double, time double, firstVisitTime double, visitCount long, typedCount long"
COLUMNS = ("url", "title", "last_visit", "visit_count", "typed_count", "first_visit", "seq")
WINDOWS, WINDOW_DAYS, WINDOW_ROWS, DAY_MS = 13, 7, 10_000, 86_400_000


def read_takeout(spark: SparkSession, path: str) -> DataFrame:
    """{"Browser History": [{title, url, time_usec}]}: a row for each visit, without counts."""
    schema = "`Browser History` array<struct<title:string,url:string,time_usec:long>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("Browser History").alias("seq", "v"))
    null = F.lit(None).cast("long")
    return rows.select("v.url", F.coalesce("v.title", F.lit("")).alias("title"), F.floor(F.col("v.time_usec") / 1000).alias("last_visit"), null.alias("visit_count"), null.alias("typed_count"), null.alias("first_visit"), F.col("seq").cast("long"))


def _from_items(items: DataFrame) -> DataFrame:
    v = lambda c: F.col(f"v.{c}")
    time = F.coalesce(v("lastVisitTime"), v("last_visit_time"), v("time"), F.lit(0.0))
    return items.select(v("url").alias("url"), F.coalesce(v("title"), F.lit("")).alias("title"), time.cast("long").alias("last_visit"), v("visitCount").alias("visit_count"), v("typedCount").alias("typed_count"), v("firstVisitTime").cast("long").alias("first_visit"), F.col("seq").cast("long").alias("seq"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of items, or one under ``items`` or ``history``; the time has any of three names."""
    bare = spark.read.schema(ITEM).json(path, multiLine=True)
    if not bare.where("url IS NOT NULL").isEmpty():
        return _from_items(bare.select(F.monotonically_increasing_id().alias("seq"), F.struct("*").alias("v")))
    item = "array<struct<url:string,title:string,lastVisitTime:double,last_visit_time:double,time:double,firstVisitTime:double,visitCount:bigint,typedCount:bigint>>"
    nested = spark.read.schema(f"items {item}, history {item}").json(path, multiLine=True)
    found = nested.withColumn("rows", F.coalesce("items", "history")).withColumn("rows", F.when(F.col("rows").isNull(), F.raise_error(F.lit("unknown shape of history export"))).otherwise(F.col("rows")))
    return _from_items(found.select(F.posexplode("rows").alias("seq", "v")))


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(rows, per_visit) of whichever shape: per visit if no row counts its visits."""
    rows = read_takeout(spark, path)
    rows = read_items(spark, path) if rows.isEmpty() else rows
    return rows, rows.where("visit_count IS NOT NULL").isEmpty()


class HistoryFile(DataSource):
    """An SQLite history file: ``urls`` and ``visits`` with WebKit times. Options: path (several by comma), table."""

    @classmethod
    def name(cls) -> str:
        return "history_sqlite"

    def schema(self) -> str:
        return "url_id long, visit_time long" if self.options.get("table") == "visits" else "id long, url string, title string, visit_count long, typed_count long, last_visit_time long"

    def reader(self, schema):
        return _HistoryReader(self.options)


class _HistoryReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.sql = "SELECT url, visit_time FROM visits" if options.get("table") == "visits" else "SELECT id, url, title, visit_count, typed_count, last_visit_time FROM urls"

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        import sqlite3

        with sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True) as db:
            yield from db.execute(self.sql)


def read_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """urls LEFT JOIN visits, the first visit by aggregation, newest first."""
    spark.dataSource.register(HistoryFile)
    read = lambda table: spark.read.format("history_sqlite").option("path", path).option("table", table).load()
    return join_visits(read("urls"), read("visits"))


def join_visits(urls: DataFrame, visits: DataFrame) -> DataFrame:
    """(url, title, last_visit, visit_count, typed_count, first_visit, seq) of history tables with WebKit times."""
    first = visits.groupBy(F.col("url_id").alias("id")).agg(F.min("visit_time").alias("first"))
    rows = urls.where("last_visit_time > 0").join(first, "id", "left")
    return rows.select("url", F.coalesce("title", F.lit("")).alias("title"), times.webkit_to_unix(F.col("last_visit_time")).alias("last_visit"), "visit_count", "typed_count", times.webkit_to_unix(F.col("first")).alias("first_visit"), F.col("id").alias("seq"))


def read_windows(rows: DataFrame, now: int, windows: int = WINDOWS, days: int = WINDOW_DAYS) -> DataFrame:
    """Rows of ``windows`` backward windows, both ends included, so that a row on a border comes twice; adds ``window``.

    One pass: each row is told its one or two windows.
    """
    span = days * DAY_MS
    back = F.lit(now) - F.col("last_visit")
    at = F.floor(back / span)
    both = F.when(back % span == 0, F.array(at - 1, at)).otherwise(F.array(at))
    return rows.where(F.col("url").isNotNull() & (back >= 0) & (back <= windows * span)).withColumn("window", F.explode(F.filter(both, lambda w: (w >= 0) & (w < windows)))).withColumn("title", F.coalesce("title", F.lit(""))).withColumn("visit_count", F.coalesce("visit_count", F.lit(1)))


def full_windows(rows: DataFrame, most: int = WINDOW_ROWS) -> DataFrame:
    """(window, n, maybe_truncated)."""
    return rows.groupBy("window").agg(F.count("*").alias("n")).withColumn("maybe_truncated", F.col("n") >= most)
