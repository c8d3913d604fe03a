"""The whole way from visits to a named corpus, its embedder and its reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagestrata.functions import embed
from pagestrata.operators import reports, search
from pagestrata.plans import backfill

VISIT = "url string, title string, last_visit long, visit_count long, typed_count long, seq long"
TOPICS = {"garden": "growing tomatoes in a small garden bed", "rockets": "launching liquid fuel rockets into orbit"}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for t, (site, title) in enumerate(TOPICS.items()):
        for i in range(12):
            rows.append((f"https://{site}.example/p{i}", f"{title} part {'abcdefghijkl'[i]}", 1000 * i + t, 1 + i % 3, 0, len(rows)))
    return backfill.backfill(spark, spark.createDataFrame(rows, VISIT), threshold=0.999, k=6, shared=1, floor=0.5, least=3)


def test_topics_are_found_and_named(corpus):
    one = backfill.summary(corpus).first()
    assert one.pages == 24 and one.clusters == 2 and one.named == 2 and one.noise_pages == 0
    sites = {(r.cluster_id, r.domain) for r in corpus.pages.collect()}
    assert len(sites) == 2
    labels = " ".join(r.label for r in corpus.clusters.collect())
    assert "rockets" in labels and "garden" in labels
    assert set(corpus.stage_ms) == set(backfill.STAGES)


def test_ask(spark, corpus):
    found = backfill.ask(spark, corpus, "liquid fuel rockets into orbit", 6).collect()
    assert [r.domain for r in found] == ["rockets.example"] * 3 + ["garden.example"] * 0 + [r.domain for r in found[3:]]
    assert found == sorted(found, key=lambda r: -r.score)
    only = backfill.ask(spark, corpus, "rockets", 4, search.Filters(domain="GARDEN")).collect()
    assert only and all(r.domain == "garden.example" for r in only)


def test_cancel(spark):
    with pytest.raises(backfill.Cancelled):
        backfill.backfill(spark, spark.createDataFrame([], VISIT), cancelled=lambda: True)


def test_empty(spark):
    corpus = backfill.backfill(spark, spark.createDataFrame([], VISIT))
    assert backfill.summary(corpus).first().pages == 0


def test_embedder_checks_dimensions(spark):
    frame = spark.createDataFrame([("a b",), (None,)], "t string")
    rows = frame.select(embed.embedder()(F.col("t")).alias("x")).collect()
    assert abs(np.linalg.norm(rows[0].x) - 1) < 1e-5 and np.linalg.norm(rows[1].x) == 0
    with pytest.raises(Exception, match="dimensions"):
        frame.select(embed.embedder(lambda: lambda texts: np.zeros((len(texts), 3)))(F.col("t"))).collect()


def test_reports(spark):
    a = spark.createDataFrame([(1, 7), (2, 7), (3, None)], "id long, cluster long")
    b = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "id long, cluster long")
    c = spark.createDataFrame([(1, 1), (2, None), (3, 1)], "id long, cluster long")
    assert reports.same_clustering(a, b).first().same is True and reports.same_clustering(a, c).first().same is False
    row = spark.range(1).select(
        reports.settings(F.lit(None).cast("array<string>")).alias("all"), reports.settings(F.array(F.lit("health"), F.lit("x"), F.lit("banking"))).alias("some"), reports.toggled(F.array(F.lit("health")), "banking", True).alias("on"),
        reports.without_names(F.lit("Visit Rome with my Dog")).alias("names"), reports.truncated(F.lit("abcdef"), 4).alias("cut")).first()
    assert row.some == ["banking", "health"] and row.on == ["banking", "health"] and len(row.all) == 6
    assert (row.names, row.cut) == ("Visit with my", "abc…")
    assert reports.paused(1000, 5) == (301_000, False) and reports.paused(0, indefinite=True) == (None, True)
    runs = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2)], "variant string, clusters long")
    assert reports.median_run(runs, "variant", "clusters").first().clusters == 2
