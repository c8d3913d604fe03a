"""Live captures: dwell clocks, gates, the keyed queue and its drain, sessions over the stream."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from pagestrata.functions import fixed, urls
from pagestrata.operators import store

TICK_MS, INPUT_MS, DWELL_MS = 1_500, 60_000, 30_000
DRAIN = 64


def dwell(ticks: DataFrame) -> DataFrame:
    """(tab, key, island, focused_ms, active_seconds, captured_at) of ticks (tab, at, key, focused, last_input): time in focus, a long gap counts a tick's most.

    A change of key starts anew, also back to an earlier key.
    """
    order = Window.partitionBy("tab").orderBy("at")
    rows = ticks.withColumn("gap", F.least(F.lit(TICK_MS), F.coalesce(F.col("at") - F.lag("at").over(order), F.lit(0))))
    rows = rows.withColumn("new", F.coalesce(F.lag("key").over(order) != F.col("key"), F.lit(True)))
    rows = rows.withColumn("island", F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    focus = F.when(F.col("focused") & ~F.col("new"), F.col("gap")).otherwise(0)
    active = F.when(F.col("at") - F.col("last_input") <= INPUT_MS, focus).otherwise(0)
    sums = rows.withColumn("f", focus).withColumn("a", active).withColumn("so_far", F.sum("f").over(Window.partitionBy("tab", "island").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    return sums.groupBy("tab", "key", "island").agg(F.sum("f").alias("focused_ms"), F.floor(F.sum("a") / 1000).alias("active_seconds"), F.min(F.when(F.col("so_far") >= DWELL_MS, F.col("at"))).alias("captured_at"))


_CLOCK = "last_at long, key string, island int, focused long, active long, sent boolean"
_READ = "tab long, key string, island int, focused_ms long, active_seconds long, captured_at long"


def dwell_stream(ticks: DataFrame, tab: str = "long") -> DataFrame:
    """The dwell clock on a stream of ticks: one row for each page at the moment that it has been in focus long enough, as ``captured(dwell(...))`` has it.

    A tab's state is its last tick, its island and its sums, so state grows with open tabs alone. Ticks that come after later ones of their tab count for no time.
    """
    import pandas as pd

    def clock(names, frames, state):
        last, key, island, focused, active, sent = state.get if state.exists else (None, None, 0, 0, 0, False)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for at, now, focus, seen in rows[["at", "key", "focused", "last_input"]].itertuples(index=False):
            gap = 0 if last is None else max(0, min(TICK_MS, int(at) - last))
            if now != key:
                key, island, focused, active, sent = now, island + 1, 0, 0, False
            elif focus:
                focused += gap
                active += gap if int(at) - int(seen) <= INPUT_MS else 0
            last = int(at) if last is None else max(last, int(at))
            if focused >= DWELL_MS and not sent:
                sent = True
                out.append((names[0], key, island, focused, active // 1000, int(at)))
        state.update((last, key, island, focused, active, sent))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _READ.split(", ")])

    return ticks.groupBy("tab").applyInPandasWithState(clock, _READ.replace("tab long", f"tab {tab}"), _CLOCK, "append", "NoTimeout")


def captured(islands: DataFrame) -> DataFrame:
    """Pages read long enough: one row each."""
    return islands.where(F.col("focused_ms") >= DWELL_MS)


def reject_reason(u: Column, url: Column, incognito: Column, paused: Column, categories: tuple[str, ...] = fixed.CATEGORIES) -> Column:
    """Why a capture isn't taken, the first that holds; null if it is."""
    return (
        F.when(incognito, "incognito").when(u.isNull() | url.isNull(), "unparsable").when(~u["scheme"].isin("http", "https"), "scheme").when(urls.is_local(u["host"]), "localhost")
        .when(paused, "paused").when(F.coalesce(urls.sensitive(u).isin(*categories), F.lit(False)), "blocked")
    )


def gate(captures: DataFrame, paused: bool = False, categories: tuple[str, ...] = fixed.CATEGORIES) -> DataFrame:
    """Adds id and reason to captures (url, incognito, ...); batch or stream."""
    rows = captures.withColumn("u", urls.parts(F.col("url")))
    rows = rows.withColumn("reason", reject_reason(F.col("u"), F.col("url"), F.col("incognito"), F.lit(paused), categories))
    return rows.withColumn("id", F.when(F.col("reason").isNull(), urls.hash_id(urls.normalize(F.col("u"))))).drop("u")


def queue(accepted: DataFrame) -> DataFrame:
    """The latest capture of each id."""
    return store.latest(accepted, "id", "queued_at")


def drain(pages: DataFrame, queued: DataFrame, most: int = DRAIN) -> tuple[DataFrame, DataFrame]:
    """(pages after, queue after): the ``most`` oldest entries are merged; running it again changes nothing more."""
    take = queued.orderBy("queued_at", "id").limit(most)
    return store.upsert(pages, store.merge_captures(pages, take)), store.delete_ids(queued, take)


def run_drain(stream: DataFrame, pages_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Merges each micro-batch of accepted captures into the page table; a replayed batch is told by its stream and number, and skipped.

    A new checkpoint is a new stream: its batches count from 0 and are all merged.
    """
    stream_id = None

    def merge(batch: DataFrame, number: int) -> None:
        nonlocal stream_id
        spark = batch.sparkSession
        if stream_id is None:  # the checkpoint's own id, the same after a restart
            stream_id = spark.read.text(f"{checkpoint}/metadata").first().value
        token = f"{json.loads(stream_id)['id']}-{number}"
        if store.written(spark, pages_path, token):
            return
        old = store.load(spark, pages_path)
        empty = spark.createDataFrame([], "id string, normalized_url string, topics array<string>, first_visit long, visit_count long, active_seconds long")
        merged = store.merge_captures(empty if old is None else old, queue(batch))
        store.save(spark, merged if old is None else store.upsert(old, merged), pages_path, token)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def debounced(captures: DataFrame, by: str, wait: str = "2 minutes", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(by, due, captures): the moments at which work put off by ``wait`` after every capture is due, one for each burst.

    Captures at most ``wait`` apart are one burst. On a stream a row comes out once the watermark has passed its due time, so a rebuild runs once a burst has settled.
    """
    rows = captures.withWatermark(time, late) if captures.isStreaming else captures
    return rows.groupBy(by, F.session_window(time, wait).alias("w")).agg(F.count("*").alias("captures")).select(by, F.col("w.end").alias("due"), "captures")


def session_stream(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows over a stream; those still open at the watermark are held back, the batch operator stays the source of truth."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
