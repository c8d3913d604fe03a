"""The command line, single runs, the stored index, answers, stored pauses, and work put off after bursts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagestrata import __main__ as cli
from pagestrata.operators import reports, search, store
from pagestrata.plans import backfill
from pagestrata.session import Busy, single_flight
from pagestrata.streaming import capture

TOPICS = {"garden": "growing tomatoes in a small garden bed", "rockets": "launching liquid fuel rockets into orbit"}


@pytest.fixture(scope="module")
def export(tmp_path_factory):
    items = [{"url": f"https://{site}.example/p{i}", "title": f"{title} part {'abcdefghijkl'[i]}", "lastVisitTime": 1000 * i + 1, "visitCount": 1 + i % 3, "typedCount": 0} for site, title in TOPICS.items() for i in range(12)]
    items += [{"url": "https://other.example/q", "title": "Untitled", "lastVisitTime": 5, "visitCount": 1, "typedCount": 0}]
    path = tmp_path_factory.mktemp("cli") / "history.json"
    path.write_text(json.dumps(items))
    return str(path)


def lines(spark, *argv):
    return list(cli.run(spark, cli.options(list(argv))))


@pytest.mark.parametrize("algo", [("knn", "--knn", "6", "--shared", "1", "--min-sim", "0.5"), ("community", "--threshold", "0.5"), ("kmeans", "--k", "2")])
def test_command_line(spark, export, tmp_path, algo):
    out = f"{tmp_path}/json"
    text = "\n".join(lines(spark, "--input", export, "--algo", *algo, "--dup-threshold", "1.1", "--min-cluster-size", "3", "--json", out))
    assert "pages 24" in text and "clusters 2" in text and "garden.example" in text and "rockets.example" in text
    rows = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert [r["settings"]["algo"] for r in rows if r["kind"] == "facts"] == [algo[0]]
    nodes = [r for r in rows if r["kind"] == "node"]
    assert len(nodes) == 24 and len([r for r in rows if r["kind"] == "page"]) == 24
    assert {r["cluster"] for r in nodes if "garden" in r["url"]}.isdisjoint({r["cluster"] for r in nodes if "rockets" in r["url"]})


def test_command_line_other_ways(spark, export, tmp_path):
    assert lines(spark, "--input", export, "--list-junk") == ["       1  Untitled"]
    text = "\n".join(lines(spark, "--input", export, "--sweep", "--limit", "10", "--dup-threshold", "1.1"))
    assert "penalty" in text
    assert cli.options(["--knn", "2"]).shared == 1 and cli.options(["--knn", "9"]).shared == 3
    with single_flight(spark, f"{tmp_path}/lock"), pytest.raises(Busy):
        lines(spark, "--input", export, "--lock", f"{tmp_path}/lock")


def test_single_flight(spark, tmp_path):
    path = f"{tmp_path}/lock"
    with single_flight(spark, path) as renew:
        renew()
        with pytest.raises(Busy), single_flight(spark, path):
            pass
        os.utime(path, (1, 1))
        with single_flight(spark, path):  # the first is taken for dead
            pass
        with single_flight(spark, path):
            pass
    assert not os.path.exists(path)
    with pytest.raises(ValueError), single_flight(spark, path):
        raise ValueError
    assert not os.path.exists(path)


def test_a_lock_taken_over_is_not_removed_by_its_first_holder(spark, tmp_path):
    path = f"{tmp_path}/lock"
    first, second = single_flight(spark, path), single_flight(spark, path)
    first.__enter__()
    os.utime(path, (1, 1))
    second.__enter__()
    first.__exit__(None, None, None)
    assert os.path.exists(path)
    second.__exit__(None, None, None)
    assert not os.path.exists(path)


def test_stored_index_follows_versions(spark, tmp_path):
    index = search.StoredIndex(spark, f"{tmp_path}/t")
    assert index.rows() is None
    page = "id long, title string, text string, cluster_id string"
    for n in range(1, 3):
        store.save(spark, spark.createDataFrame([(i, "t", "x", None) for i in range(n)], page), f"{tmp_path}/t")
        assert index.rows().count() == n and index.rows() is index.rows()
    index.drop()
    assert index.rows().count() == 2


def test_answer(spark, export):
    from pagestrata.sources import history

    rows, per_visit = history.read_history(spark, export)
    corpus = backfill.backfill(spark, rows, per_visit=per_visit, threshold=0.999, k=6, shared=1, floor=0.5, least=3)
    found = backfill.answer(spark, corpus, "liquid fuel rockets into orbit", 6)
    assert len(found.hits) == 6 and found.hits[0].domain == "rockets.example" and found.scanned == 24 and set(found.timings) == {"load_ms", "embed_ms", "scan_ms", "total_ms"}


@pytest.mark.parametrize(("raw", "until", "indefinite"), [('{"until":5}', 5, False), ('{"until":"indefinite"}', None, True), ('{"until":"5"}', None, False), ('{"until":null}', None, False), ("{}", None, False), ("x", None, False), (None, None, False), ("[1]", None, False), ('{"until":true}', None, False)])
def test_stored_pause(spark, raw, until, indefinite):
    row = spark.createDataFrame([(raw,)], "raw string").select(reports.pause_until(F.col("raw")).alias("p")).first().p
    assert (row.until, row.indefinite) == (until, indefinite)


def test_bursts_on_a_stream(spark, tmp_path):
    times = [0, 30, 150, 271, 1000, 5000]
    for i, part in enumerate((times[:3], times[3:])):
        spark.createDataFrame([(1, t) for t in part], "tab long, t long").select("tab", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("tab long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = capture.debounced(stream, "tab").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination()
    seconds = F.unix_seconds("due")
    assert sorted((r.s, r.captures) for r in spark.read.parquet(f"{tmp_path}/out").select(seconds.alias("s"), "captures").collect()) == [(270, 3), (391, 1), (1120, 1)]
    batch = capture.debounced(spark.read.parquet(f"{tmp_path}/in/0", f"{tmp_path}/in/1"), "tab").select(seconds.alias("s"), "captures")
    assert sorted(map(tuple, batch.collect())) == [(270, 3), (391, 1), (1120, 1), (5120, 1)]
