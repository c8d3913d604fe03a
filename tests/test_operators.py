"""Operators against plain computations."""

import random
import sqlite3

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagestrata.operators import filtering, labels, search, sessions, store, vectors
from pagestrata.operators.graph import components
from pagestrata.sources import history
from pagestrata.streaming import capture

VISIT = "url string, title string, last_visit long, visit_count long, typed_count long, seq long"


def plain_fold(rows, per_visit):
    out = {}
    for url, title, last, count, seq in rows:
        key, count = url.split("?")[0], count or 1
        if key not in out:
            out[key] = [url, title, last, count]
            continue
        e = out[key]
        if per_visit:
            e[3] += 1
        elif count > e[3]:
            e[3], e[0] = count, url
            e[1] = title or e[1]
        e[2] = max(e[2], last)
        e[1] = e[1] or title
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("per_visit", [False, True])
def test_fold(spark, per_visit):
    draw = random.Random(4)
    rows = [(f"https://s.com/{draw.randint(0, 6)}?v={i}", draw.choice(["", "A", "B", "C"]), draw.randint(0, 99), draw.choice([None, 1, 2, 3, 4]), i) for i in range(200)]
    frame = spark.createDataFrame([(r[0].split("?")[0], r[0], "s.com", r[1], r[2], r[3] or 1, 0, r[4]) for r in rows], "normalized_url string, url string, domain string, title string, last_visit long, visit_count long, typed_count long, seq long")
    got = {r.normalized_url: (r.url, r.title, r.last_visit, r.visit_count) for r in filtering.fold(frame, per_visit).collect()}
    assert got == plain_fold(rows, per_visit)


def test_filter_chain(spark):
    rows = [
        (None, "x", 1), ("", "x", 2), ("nope", "x", 3), ("ftp://a.com/x", "t", 4), ("http://localhost/x", "t", 5), ("https://chase.com/x", "t", 6), ("https://google.com/search?q=1", "t", 7),
        ("https://a.com/one?utm_source=x", "A perfectly fine page title", 8), ("https://a.com/one", "A perfectly fine page title", 9), ("https://a.com/two", "Sign in", 10), ("https://a.com/three", "Too short", 11),
        ("https://b.com/nice-words/here", "https://b.com/nice-words/here/and/more", 12), ("https://b.com/1/2", "https://b.com/1/2/3/4/5/6/7/8/9/10/11", 13),
    ]
    visits = spark.createDataFrame([(u, t, 100 + s, 1, 0, s) for u, t, s in rows], VISIT)
    found = filtering.filter_visits(visits)
    drops = {(r.reason, r.key): r.n for r in found.drops.collect()}
    assert drops[("no-url", "(empty)")] == 2 and drops[("no-url", "nope")] == 1 and drops[("scheme", "ftp:")] == 1
    assert drops[("localhost", "localhost")] == 1 and drops[("blocked", "chase.com")] == 1 and drops[("search", "google.com")] == 1
    assert drops[("duplicate", "a.com")] == 1 and drops[("junk-title", "Sign in")] == 1 and drops[("short-title", "Too short")] == 1
    kept = {r.normalized_url: r for r in found.pages.collect()}
    assert set(kept) == {"https://a.com/one", "https://b.com/nice-words/here"}
    assert kept["https://b.com/nice-words/here"].path_rescued and kept["https://b.com/nice-words/here"].embed_text == "nice words here"
    one = filtering.reconcile(found).first()
    assert one.reconciles and one.raw == 13 and one.kept == 2
    assert filtering.filter_visits(visits, categories=()).drops.where("reason = 'blocked'").isEmpty()


def test_filter_empty(spark):
    found = filtering.filter_visits(spark.createDataFrame([], VISIT))
    assert found.pages.count() == 0 and filtering.reconcile(found).first().reconciles


def test_session_borders(spark):
    page = "id string, title string, domain string, first_visit long, last_visit long, active_seconds long, captured boolean"
    at = lambda i, ms, **k: (str(i), "t", k.get("domain", "d"), ms, ms, k.get("active", 0), k.get("captured", True))
    gap = 30 * 60_000
    got = sessions.build(spark.createDataFrame([at(0, 0), at(1, gap), at(2, 2 * gap + 1)], page), 0).collect()
    assert sorted(s.page_count for s in got) == [1, 2]
    # Sessions across day borders, against a plain scan.
    draw = random.Random(2)
    times_ = sorted(draw.randint(0, 4 * 86_400_000) for _ in range(400))
    runs, last = [], None
    for t in times_:
        if last is None or t - last > gap:
            runs.append(0)
        runs[-1] += 1
        last = t
    got = sessions.build(spark.createDataFrame([at(i, t) for i, t in enumerate(times_)], page), 0).orderBy("start").collect()
    assert [s.page_count for s in got] == runs


@pytest.mark.parametrize(
    ("pages", "want"),
    [
        ([(0, "d", True)] * 6, True), ([(0, "d", False)] * 6, None), ([(0, "d", True)] * 4, False), ([(0, "a", True)] * 3 + [(0, "b", True)] * 5, True),
        ([(9, "a", True)] * 8, False),
    ],
)
def test_passive(spark, pages, want):
    rows = [(str(i), "t", d, i * 60_000, i * 60_000, a, c) for i, (a, d, c) in enumerate(pages)]
    got = sessions.build(spark.createDataFrame(rows, "id string, title string, domain string, first_visit long, last_visit long, active_seconds long, captured boolean"), 0).first()
    assert got.passive is want



def test_endless_session_in_buckets(spark, monkeypatch):
    """Without a key, buckets are of rows: no window holds a session, and streaks go on across their borders."""
    monkeypatch.setattr(sessions, "BUCKET_ROWS", 40, raising=False)
    draw = random.Random(3)
    rows, at = [], 0
    for i in range(1_200):
        calm = 60 < i % 300 < 60 + i // 5
        at += draw.choice(([0, 1_000] if calm else [0, 1_000, 200_000]) if i % 300 else [9_000_000])
        rows.append((i, "t", "d" if calm else draw.choice(["d", "e", None]), at, at, 0 if calm else draw.randint(0, 9), True))
    want, runs = [], []
    for r in rows:
        if not runs or r[4] - runs[-1][-1][4] > sessions.GAP_MS:
            runs.append([])
        runs[-1].append(r)
    for run in runs:
        longest = n = 0
        for k, r in enumerate(run):
            idle = (k + 1 == len(run) or run[k + 1][4] - r[4] <= sessions.PASSIVE_PAGE_MS) and r[5] <= sessions.PASSIVE_SECONDS
            same = not k or run[k - 1][2] is None or r[2] is None or run[k - 1][2] == r[2]
            n = n + 1 if idle and same else int(idle)
            longest = max(longest, n)
        want.append((run[0][3], len(run), longest >= 5 and longest * 2 >= len(run)))
    frame = spark.createDataFrame(rows, "id long, title string, domain string, first_visit long, last_visit long, active_seconds long, captured boolean").repartition(5)
    got = sessions.build(frame, 0, with_pages=False).orderBy("start").collect()
    assert [(r.start, r.page_count, r.passive) for r in got] == want and {w[2] for w in want} == {True, False}
    assert sessions._bucketed(frame, [], "last_visit", "id", sessions.GAP_MS).groupBy("_b").count().agg(F.max("count")).first()[0] < 200


def test_diversity(spark):
    rows = spark.createDataFrame([(1, "A", 0.9), (2, "A", 0.8), (3, "A", 0.7), (4, "A", 0.6), (5, "B", 0.5)], "id long, domain string, score double")
    assert [r.id for r in search.diversify(rows, 4).collect()] == [1, 2, 3, 5]
    assert [r.id for r in search.diversify(rows, 5).collect()] == [1, 2, 3, 4, 5]


def test_filters():
    f = search.Filters.parse(start=" 5 ", end="x", domain="  ")
    assert (f.start_time, f.end_time, f.domain) == (5, None, None)


def unit(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_collapse_and_neighbours(spark):
    x = unit(60, 8, 1)
    x[40:50] = x[3] + 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x[i].tolist(), i % 4, f"t{i}") for i in range(60)], "id long, x array<double>, visit_count long, title string")
    sims = x @ x.T
    groups = {r.id: (r.group, r.pos) for r in vectors.collapse(spark, rows, 0.97).collect()}
    for i in range(60):
        assert groups[i][0] == min(j for j in range(60) if sims[i, j] >= 0.97 or j == i)
    near = vectors.neighbours(rows, 3, 0.0, block=17).collect()
    for i in range(60):
        want = sorted((-sims[i, j], j) for j in range(60) if j != i and sims[i, j] >= 0)[:3]
        got = sorted((r.rank, r.dst) for r in near if r.src == i)
        assert [j for _, j in got] == [j for _, j in want]


def test_blocks_stay_few(spark):
    """However small the blocks may be, their number is bounded, and each row is sent once for each of them."""
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(600)], "id long, x array<double>")
    sent = vectors._met(rows, 5, lambda sides: pa.table({"n": [len(sides.ids)]}), "n long").collect()
    assert len(sent) == vectors.FEW * (vectors.FEW + 1) // 2 and sum(r.n for r in sent) == vectors.FEW * 600


def test_equal_vectors_tie(spark):
    """Similarities are the same to the bit whatever the blocks, so copies of a vector rank by id."""
    x = unit(40, 64, 5).astype(np.float32)
    rows = spark.createDataFrame([(i, x[i % 40].tolist()) for i in range(400)], "id long, x array<float>")
    for block in (37, 2_048):
        near = vectors.neighbours(rows, 12, -2.0, block=block).collect()
        for i in (0, 41, 399):
            want = [j for j in range(400) if j % 40 == i % 40 and j != i]
            assert [r.dst for r in sorted((r for r in near if r.src == i), key=lambda r: r.rank)][: len(want)] == want
            assert len({r.sim for r in near if r.src == i and r.dst in want}) == 1


def test_links_of_many_copies(spark):
    x = np.repeat(unit(30, 8, 2), 20, axis=0)
    rows = spark.createDataFrame([(i * 7 % 600, x[i].tolist()) for i in range(600)], "id long, x array<double>")
    edges = vectors.links(rows, 0.999, block=100)
    stars = edges.count()
    assert stars <= vectors._met(rows, 100, lambda sides: pa.table({"n": [len(sides.ids)]}), "n long").agg(F.sum("n")).first()[0]
    want = {i * 7 % 600: min(j * 7 % 600 for j in range(600) if x[i] @ x[j] >= 0.999) for i in range(600)}
    assert {r.node: r.component for r in components(spark, edges).collect()} == want


def test_community(spark):
    x = unit(80, 4, 3)
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(80)], "id long, x array<double>")
    hood = {i: {j for j in range(80) if x[i] @ x[j] >= 0.8 or i == j} for i in range(80)}
    free, want = set(range(80)), {}
    for i in sorted((i for i in hood if len(hood[i]) >= 3), key=lambda i: (-len(hood[i]), i)):
        mine = hood[i] & free
        if len(mine) >= 3:
            want |= {j: i for j in mine}
        free -= mine if len(mine) >= 3 else set()
    got = {r.id: r.cluster for r in vectors.community(spark, rows, 0.8, 3).collect() if r.cluster is not None}
    assert got == want


@pytest.mark.parametrize("most", [60, 1 << 22])
def test_community_in_batches(spark, monkeypatch, most):
    """Batches of few edges give the walk's result, and no number of edges is too many."""
    monkeypatch.setattr(vectors, "MOST_EDGES", most)
    monkeypatch.setattr(vectors, "SEEDS_AT_ONCE", 4)
    x = unit(90, 4, 7)
    x[50:60] = x[3]
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(90)], "id long, x array<double>")
    hood = {i: {j for j in range(90) if x[i] @ x[j] >= 0.6 or i == j} for i in range(90)}
    free, want = set(range(90)), {}
    for i in sorted((i for i in hood if len(hood[i]) >= 3), key=lambda i: (-len(hood[i]), i)):
        mine = hood[i] & free
        if len(mine) >= 3:
            want |= {j: i for j in mine}
            free -= mine
    assert {r.id: r.cluster for r in vectors.community(spark, rows, 0.6, 3).collect() if r.cluster is not None} == want


@pytest.mark.parametrize(("n", "copies", "scale"), [(1_500, 1, 1.0), (1_500, 5, 3.0), (3, 1, 1.0), (1, 1, 1.0)])
def test_profile_of_all_pairs(spark, n, copies, scale):
    """Exact percentiles of all pairs at every size, of vectors of any length."""
    x = np.repeat(unit(n // copies, 8, 4), copies, axis=0) * scale
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "id long, x array<double>")
    got = vectors.profile(rows).first()
    sims = (x @ x.T)[np.triu_indices(len(x), 1)]
    assert got.pairs == len(sims)
    want = np.quantile(sims, (0.5, 0.9, 0.99, 0.999, 1.0)) if len(sims) else [None] * 5
    assert [got[i] for i in range(5)] == (pytest.approx(list(want), abs=1e-12) if len(sims) else want)


def test_variant_run_of_copies(spark, tmp_path):
    """The query's pages are nodes one by one, as in its SQL, also where some are copies."""
    import duckdb

    from pagestrata.plans import similarity

    x = unit(300, 16, 6).astype(np.float32)
    x[100:130] = x[7]
    spark.createDataFrame([(i, x[i].tolist(), i % 5) for i in range(300)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert tuple(similarity.variant_run(spark, str(tmp_path)).first()) == pytest.approx(con.execute(similarity.SQL["variant_run"]).fetchone())
    rows = similarity._rows(spark, str(tmp_path))
    assert vectors.run_variant(spark, rows, shared=2, least=3).first().nodes == 270


def test_kmeans(spark):
    x = np.vstack([unit(20, 6, 1) * 0.05 + np.eye(6)[k] for k in range(3)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "id long, x array<double>")
    got = {r.id: r.cluster for r in vectors.kmeans(spark, rows, 3).collect()}
    assert len({(i // 20, got[i]) for i in range(60)}) == 3


@pytest.mark.parametrize(("parts", "per_task"), [(1, 100_000), (7, 100_000), (7, 40)])
def test_components(spark, parts, per_task):
    draw = random.Random(1)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "u long, v long").repartition(parts), per_task).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_labels(spark):
    rows = [("a", f"{i}", "deep learning rocks") for i in range(3)] + [("b", f"{i}", "garden soil notes") for i in range(3)] + [("c", "0", "!!!")]
    got = {r["class"]: r.label for r in labels.label(spark.createDataFrame(rows, "class string, title_id string, title string")).collect()}
    assert got == {"a": "deep learning rocks", "b": "garden soil notes", "c": None}


def test_labels_send_no_phrases_to_the_driver(spark, tmp_path):
    """By the size of the titles all would be broadcast; only the number of classes, one row, is."""
    titles = spark.createDataFrame([(i % 3, str(i), f"deep learning rocks {i}") for i in range(30)], "class long, title_id string, title string")
    titles.write.parquet(str(tmp_path / "titles"))  # of a file the plan knows the size
    titles = spark.read.parquet(str(tmp_path / "titles"))
    for frame in (labels.term_scores(titles), labels.label(titles)):
        plan = frame._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" not in plan and plan.count("BroadcastExchange") <= 2 * plan.count("BroadcastNestedLoopJoin")


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, store.upsert(old, new).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    meta = store.merge_meta(spark.createDataFrame([("h", 1, None)], "key string, last_capture_at long, reloaded_at long"), spark.createDataFrame([("h", None, 5)], "key string, last_capture_at long, reloaded_at long"))
    assert tuple(store.health(meta, 10**9).first()) == ("h", 1, 5, True, True)


def test_sources(spark, tmp_path):
    (tmp_path / "takeout.json").write_text('{"Browser History":[{"title":"T","url":"https://a.com","time_usec":1700000000123456}]}')
    (tmp_path / "items.json").write_text('[{"url":"https://a.com","title":"T","lastVisitTime":1700000000123.4,"visitCount":3}]')
    (tmp_path / "nested.json").write_text('{"items":[{"url":"https://a.com","time":5}]}')
    rows, per_visit = history.read_history(spark, str(tmp_path / "takeout.json"))
    assert per_visit and rows.first().last_visit == 1700000000123
    rows, per_visit = history.read_history(spark, str(tmp_path / "items.json"))
    assert not per_visit and rows.first().visit_count == 3
    rows, per_visit = history.read_history(spark, str(tmp_path / "nested.json"))
    assert per_visit and rows.first().last_visit == 5
    with sqlite3.connect(tmp_path / "h.db") as db:
        db.executescript("CREATE TABLE urls(id INTEGER, url TEXT, title TEXT, visit_count INTEGER, typed_count INTEGER, last_visit_time INTEGER); CREATE TABLE visits(url INTEGER, visit_time INTEGER); INSERT INTO urls VALUES (1,'u','t',2,1,13350000000000000),(2,'v','t',1,0,0); INSERT INTO visits VALUES (1,13340000000000000),(1,13345000000000000);")
    got = history.read_sqlite(spark, str(tmp_path / "h.db")).collect()
    assert [(r.url, r.last_visit, r.first_visit) for r in got] == [("u", 1705526400000, 1695526400000)]


def test_drain_stream(spark, data, tmp_path):
    schema = "id string, url string, title string, text string, extraction_tier int, captured_at long, queued_at long, active_seconds long"
    spark.createDataFrame([("a", "https://a.com/x", "t1", "one", 2, 10, 1, 5), ("a", "https://a.com/x", "t2", "two", 2, 20, 2, 5)], schema).write.parquet(str(tmp_path / "in"))
    start = lambda: capture.run_drain(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "pages"), str(tmp_path / "check")).awaitTermination(60)
    start()
    spark.createDataFrame([("a", "https://a.com/x", "t3", "three", 2, 30, 3, 7)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    start()
    row = spark.read.parquet(str(tmp_path / "pages/v1")).first()
    assert (row.title, row.visit_count, row.active_seconds, row.first_visit, row.last_visit) == ("t3", 2, 12, 20, 30)


def test_session_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(data).withColumn("ts", F.col("ts").cast("timestamp"))
    query = capture.session_stream(stream).writeStream.format("memory").queryName("session_stream").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    pages = events.select(F.col("event_id").alias("id"), "user_id", F.expr("unix_millis(CAST(ts AS TIMESTAMP))").alias("last_visit"))
    batch = sessions.number_runs(pages, ["user_id"], gap=30 * 60_000 - 1).select("user_id", "run").distinct().count()
    assert 0 <= batch - spark.table("session_stream").count() <= 5


def test_places_over_partitions(spark):
    """Places are those of a plain sort, over many partitions, with nulls, repeated rows and none at all."""
    from pyspark.sql import functions as F

    from pagestrata.operators import ordering

    rows = [(None if i % 11 == 0 else i * 7919 % 50, i) for i in range(3_000)] + [(5, 1), (5, 1)]
    frame = spark.createDataFrame(rows, "a int, b long").repartition(7)
    with_places = ordering.numbered(frame, F.desc("a"), "b")
    assert with_places.columns == ["a", "b", "place"]
    got = sorted((r.place, r.a, r.b) for r in with_places.collect())
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == [(i, *r) for i, r in enumerate(want)]
    assert ordering.numbered(frame.where("b < 0"), "a", "b").collect() == []
