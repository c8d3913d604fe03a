"""Streams of captures and the stored table they feed; stalls; small helpers of stores and times."""

import random

import pytest
from pyspark.sql import functions as F

from pagestrata.functions import times
from pagestrata.operators import search, store, vectors, views
from pagestrata.streaming import capture

TICKS = "tab long, at long, key string, focused boolean, last_input long"
ACCEPTED = "id string, url string, title string, text string, extraction_tier int, captured_at long, queued_at long, active_seconds long"


def test_dwell_on_a_stream(spark, tmp_path):
    draw, rows, at = random.Random(1), [], {1: 0, 2: 500}
    for _ in range(900):
        tab = draw.choice([1, 2])
        at[tab] += draw.choice([900, 1000, 1100, 4000])
        rows.append((tab, at[tab], f"p{at[tab] // 90_000 % 3}", draw.random() < 0.9, at[tab] - draw.choice([0, 70_000])))
    half = rows[len(rows) // 2][1]
    for i, part in enumerate(([r for r in rows if r[1] < half], [r for r in rows if r[1] >= half])):
        spark.createDataFrame(part, TICKS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = capture.dwell_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination()
    got = {(r.tab, r.key, r.island, r.captured_at) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.tab, r.key, r.island, r.captured_at) for r in capture.captured(capture.dwell(spark.createDataFrame(rows, TICKS))).collect()}
    assert got == want and len(got) > 3


def test_drain_of_a_new_stream_on_an_old_table(spark, tmp_path):
    pages = f"{tmp_path}/pages"
    for n in range(2):
        spark.createDataFrame([(f"i{n}", f"https://a.example/{n}", "t", "x", 2, 100 + n, 100 + n, 7), ("same", "https://a.example/s", "t", "x", 2, 100 + n, 100 + n, 7)], ACCEPTED).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
        stream = spark.readStream.schema(ACCEPTED).parquet(f"{tmp_path}/in{n}")
        for _ in range(2):  # the second start of one checkpoint has nothing new
            capture.run_drain(stream, pages, f"{tmp_path}/c{n}").awaitTermination()
    got = {r.id: r.visit_count for r in store.load(spark, pages).collect()}
    assert got == {"i0": 1, "i1": 1, "same": 2}


def test_versions_are_kept_in_number(spark, tmp_path):
    for n in range(5):
        store.save(spark, spark.createDataFrame([(n,)], "x int"), f"{tmp_path}/t", token=f"k-{n}")
    assert store.load(spark, f"{tmp_path}/t").first().x == 4 and store.written(spark, f"{tmp_path}/t", "k-3") and not store.written(spark, f"{tmp_path}/t", "k-9")
    assert not (tmp_path / "t/v0").exists() and (tmp_path / "t/v2").exists()


def test_stalls_meet_the_stage_they_overlap_most(spark):
    draw = random.Random(2)
    stages = [(r, f"s{i}", float(draw.randint(0, 10_000))) for r in range(3) for i in range(12)]
    stalls = [(r, i, a := float(draw.randint(-500, 11_000)), a + draw.choice([1.0, 50.0, 400.0])) for r in range(3) for i in range(60)]
    found = views.attribute_stalls(spark.createDataFrame(stalls, "run int, stall_id int, `from` double, `to` double"), spark.createDataFrame(stages, "run int, stage string, at double")).collect()
    assert len(found) == len(stalls)
    ends = {}
    for r in range(3):
        own = sorted((a, s) for q, s, a in stages if q == r)
        ends[r] = [(a, s, own[i + 1][0] if i + 1 < len(own) else float("inf")) for i, (a, s) in enumerate(own)]
    for x in found:
        best = max((min(x.to, until) - max(x["from"], a), -a, s) for a, s, until in ends[x.run])
        assert (x.stage, x.offset) == (best[2], max(0.0, x["from"] + best[1])), x


def test_largest_groups_and_names(spark):
    groups = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 3, 0), (4, 4, 0), (5, 4, 1), (6, 4, 2)], "id long, group long, pos int")
    pages = spark.createDataFrame([(i, f"t{i}") for i in range(1, 7)], "id long, title string")
    assert [(r.group, r.n, r.title) for r in views.largest_groups(groups, pages).orderBy(F.desc("n")).collect()] == [(4, 3, "t4"), (1, 2, "t1")]
    members = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 5), (5, 5), (6, None)], "id long, cluster long")
    names = {r.cluster: r.name for r in vectors.cluster_names(members).collect()}
    assert names[9].startswith("c0-") and names[5].startswith("c1-") and len(names) == 2
    assert names == {r.cluster: r.name for r in vectors.cluster_names(members.orderBy(F.desc("id"))).collect()}


@pytest.mark.parametrize(("text", "want"), [("1e3", 1000), (" 5 ", 5), ("", None), ("nan", None), ("x", None), ("1e999", None)])
def test_form_numbers(text, want):
    assert search.Filters.parse(start=text).start_time == want


def test_kmeans_keeps_no_empty_centre(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100 + i, [0.0, 1.0]) for i in range(30)]
    got = vectors.kmeans(spark, spark.createDataFrame(rows, "id long, x array<double>"), 2, rounds=4)
    assert got.select("cluster").distinct().count() == 2
    assert spark.range(1).select(times.from_input(F.lit("2024-01-02T03:04")).alias("t")).first().t == 1_704_164_640_000
