"""Exact top-k inner products by best-first search in M-trees.

Components become whole numbers, floor(scale * x). With every vector x extended by
sqrt(M^2 - |x|^2), M the largest norm, and a query by 0, the squared distance is |q|^2 + M^2 - 2 q.x: the largest
inner products are the nearest neighbours of a metric space.

The root node lives on the driver: its routing objects are drawn from a bounded sample, each vector is indexed under its
nearest one, and the vectors of a routing object are cut by their distance to it into pages of bounded size, of which
the driver keeps the distances' ends (three numbers a page). A page is an M-tree, loaded in bulk: a node's routing object is one of its
vectors, with a covering radius and the distance to the parent's routing object, and leaf entries keep their distance to
theirs. A query goes to those pages whose distances may hold one of its best, given what the sample alone
yields; there each query has a queue of nodes ordered by their least possible distance, opens the nearest until it can't
improve the k-th score, and the stored distances to parents rule nodes and entries out by the triangle inequality before any
distance or product is computed. Pages travel only where queries ask for them, once for every BLOCK of those.

Products are exact integers (those beyond 64 bits count as the nearest 64-bit number); bounds have slack for rounding; equal scores go to the smaller id.
Vectors that are null or hold null or non-finite components take no part, nor do rows without id. A row is no candidate of
a query with its id. Queries of one id are one query, with the least of its vectors; candidates of one id are
rows of their own. Shorter vectors count as padded with zeros. A table with one vector yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.llm.common import checkpointed

SCALE, TOP, EVERY = 256, 5, 50
#: Rows of the sample, routing objects, rows of a page, rows of a leaf, children of a node, queries that meet a page at once.
SAMPLE, ROUTES, PAGE, LEAF, FAN, BLOCK = 2_048, 64, 4_096, 128, 12, 2_048
SLACK = 1e-6
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole(vectors: pa.Array | pa.ChunkedArray, dim: int, scale: int = SCALE) -> np.ndarray:
    """The scaled vectors as float64 with whole values, padded to ``dim``."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    out = np.zeros((len(vectors), dim))
    sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) == out.size:
        return flat.reshape(out.shape)
    out[np.repeat(np.arange(len(vectors)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors as int64; what lies beyond is the nearest int64."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[-1] >= 2**53:
        whole_ = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object)
        return np.clip(whole_(a).dot(whole_(b).T), _LOW + 1, _HIGH).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def extend(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0, d))


def reach(score: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The distance within which all vectors with at least a score lie, with room for rounding; _LOW reaches everything."""
    with np.errstate(invalid="ignore", over="ignore"):
        far = np.sqrt(np.maximum(0, norm - 2 * score.astype(np.float64)))
    return np.where(score == _LOW, np.inf, far + SLACK * (far + np.sqrt(norm) + 1))


class Tree:
    """An M-tree over the whole vectors of one page, loaded in bulk.

    Nodes are numbered; of each: its routing object (a row), covering radius, distance to the parent's routing object,
    and either its children or, in a leaf, its rows with their distances to the routing object.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float, leaf: int = LEAF, fan: int = FAN, seed: int = 0):
        self.ids, self.vectors, self.points = ids, vectors, extend(vectors, most)
        draw = np.random.default_rng(seed)
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.route: list[int] = []
        self.children: list[np.ndarray | None] = []
        self.entries: list[tuple[np.ndarray, np.ndarray] | None] = []

        def add(route: int, rows: np.ndarray, own: np.ndarray, up: float) -> int:
            self.route.append(route)
            self.radius.append(float(own.max()))
            self.to_parent.append(up)
            self.children.append(None)
            self.entries.append((rows, own))
            return len(self.route) - 1

        if not len(ids):
            return
        every = np.arange(len(ids))
        top = int(draw.integers(len(ids)))
        todo = [add(top, every, distances(self.points, self.points[top : top + 1])[:, 0], 0.0)]
        while todo:
            node = todo.pop()
            rows, own = self.entries[node]
            if len(rows) <= leaf or self.radius[node] <= SLACK:
                continue
            routes = np.append(self.route[node], draw.choice(rows, fan - 1, replace=False))  # the parent's object may stay one
            between = distances(self.points[rows], self.points[routes])
            near = between.argmin(axis=1)
            parts = [(int(routes[j]), near == j, j) for j in range(fan) if (near == j).any()]
            if len(parts) < 2:
                continue
            up = distances(self.points[routes], self.points[self.route[node]][None])[:, 0]
            made = [add(r, rows[part], between[part, j], float(up[j])) for r, part, j in parts]
            self.children[node], self.entries[node] = np.array(made), None
            todo += made

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, most: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids and scores of each query, _LOW where there are fewer: among those that reach its floor, without its own id.

        ``queue[i]`` holds the least possible distance of every node that query i has met and not opened. Each turn takes
        every query's nearest node; queries that open one node in the same turn share its distances or products.
        """
        n, nodes = len(queries), len(self.route)
        ids, scores = np.full((n, k), _HIGH), np.full((n, k), _LOW)
        if not n or not nodes:
            return ids, scores
        points = np.hstack([queries, np.zeros((n, 1))])
        norm = (queries * queries).sum(axis=1) + most
        radius = reach(floor, norm)
        queue, far = np.full((n, nodes), np.inf), np.full((n, nodes), np.inf)
        far[:, 0] = distances(points, self.points[self.route[0]][None])[:, 0]
        queue[:, 0] = np.maximum(0, far[:, 0] - self.radius[0])
        radii, ups = np.array(self.radius), np.array(self.to_parent)
        active = np.arange(n)
        while len(active):
            node = queue[active].argmin(axis=1)
            on = queue[active, node] <= radius[active]
            on &= np.isfinite(queue[active, node])
            active, node = active[on], node[on]
            queue[active, node] = np.inf
            for j in np.unique(node):
                q = active[node == j]
                if self.children[j] is not None:
                    below = self.children[j]
                    bound = np.abs(far[q, j][:, None] - ups[below][None]) - radii[below][None]
                    open_ = below[(bound <= radius[q, None]).any(axis=0)]
                    if len(open_):
                        d = distances(points[q], self.points[[self.route[i] for i in open_]])
                        far[np.ix_(q, open_)] = d
                        queue[np.ix_(q, open_)] = np.maximum(0, d - radii[open_][None])
                else:
                    self._leaf(j, q, queries, own, floor, far, radius, norm, ids, scores, k)
        return ids, scores

    def _leaf(self, j, q, queries, own, floor, far, radius, norm, ids, scores, k) -> None:
        rows, dist = self.entries[j]
        rows = rows[(np.abs(dist[None] - far[q, j][:, None]) <= radius[q, None]).any(axis=0)]
        if not len(rows):
            return
        found = products(queries[q], self.vectors[rows])
        found[(found < floor[q, None]) | (self.ids[rows][None] == own[q, None])] = _LOW
        better = (found >= np.maximum(scores[q, -1:], _LOW + 1)).any(axis=1)
        q, found = q[better], found[better]
        if not len(q):
            return
        all_ids = np.hstack([ids[q], np.where(found == _LOW, _HIGH, np.broadcast_to(self.ids[rows], found.shape))])
        all_scores = np.hstack([scores[q], found])
        top = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]  # ~ reverses the order without overflow
        ids[q], scores[q] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_scores, top, 1)
        full = q[scores[q, -1] > _LOW]
        radius[full] = np.minimum(radius[full], reach(scores[full, -1], norm[full]))


class Directory:
    """The root: routing objects, and by routing object its pages in order of distance, as rings [lo, hi] with a number of equal parts."""

    def __init__(self, routes: np.ndarray, rings: dict[int, list[tuple[float, float, int]]]):
        self.routes = routes
        self.lo, self.hi, self.first, self.parts = {}, {}, {}, {}
        self.pages = 0
        for r, own in sorted(rings.items()):
            parts = np.array([p for *_, p in own], np.int64)
            self.lo[r], self.hi[r], self.parts[r] = np.array([a for a, *_ in own]), np.array([b for _, b, _ in own]), parts
            self.first[r] = self.pages + np.concatenate([[0], np.cumsum(parts)])
            self.pages += int(parts.sum())

    def page(self, route: np.ndarray, d: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The page of each vector, by its routing object and the distance to it; equal distances are dealt by id."""
        out = np.zeros(len(d), np.int64)
        for r in np.unique(route):
            on = route == r
            ring = np.searchsorted(self.hi[r], d[on])
            out[on] = self.first[r][ring] + (ids[on].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % self.parts[r][ring]
        return out

    def asked(self, d: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, page): the pages that may hold a vector within ``far`` of a query with distances ``d`` to the routing objects."""
        rows, pages = [], []
        for r in self.lo:
            a = self.first[r][np.searchsorted(self.hi[r], d[:, r] - far)]
            b = self.first[r][np.searchsorted(self.lo[r], d[:, r] + far, side="right")]
            n = np.maximum(0, b - a)
            rows.append(np.repeat(np.arange(len(d)), n))
            pages.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n))
        return (np.concatenate(rows), np.concatenate(pages)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _rings(placed: DataFrame, page: int) -> dict[int, list[tuple[float, float, int]]]:
    """By routing object: (lo, hi, equal parts) of its rings of about ``page`` vectors; three numbers a page come to the driver."""
    sizes = {r.route: r.n for r in placed.groupBy("route").agg(F.count("*").alias("n")).collect()}
    cuts = F.lit(None).cast("array<double>")
    for n in sorted({-(-n // page) for n in sizes.values()}):
        of = [r for r, m in sizes.items() if -(-m // page) == n]
        cuts = F.when(F.col("route").isin(of), F.percentile_approx("d", F.lit([(i + 1) / n for i in range(n)]), F.lit(10_000))).otherwise(cuts)
    ends = {r.route: sorted(set(r.cuts)) for r in placed.groupBy("route").agg(cuts.alias("cuts")).collect()}
    of = F.create_map(*(x for r, e in ends.items() for x in (F.lit(r), F.array(*map(F.lit, e)))))
    ring = F.size(F.filter(of[F.col("route")], lambda e: e < F.col("d")))
    counted = placed.groupBy("route", ring.alias("ring")).agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).collect()
    out: dict[int, list[tuple[float, float, int]]] = {}
    for x in sorted(counted, key=lambda x: (x.route, x.ring)):
        out.setdefault(x.route, []).append((x.lo, x.hi, -(-x.n // (2 * page))))
    return out


def top_k(spark: SparkSession, table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = TOP, scale: int = SCALE, page: int = PAGE, block: int = BLOCK, routes: int = ROUTES) -> DataFrame:
    """(query_id, rank, key, score): for each row whose id ``every`` divides, the k highest inner products among all others."""
    sound = F.col(vector).isNotNull() & F.col(key).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.where(sound).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.floor(v * scale).cast("double") * F.floor(v * scale))
    dim, most = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    schema = f"query_id long, rank int, {key} long, score long"
    if not dim:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    known, known_ids = whole(sample["x"], dim, scale), sample["id"].to_numpy()
    centres = extend(known, most)[np.random.default_rng(7).permutation(len(known))[:routes]]
    root = spark.sparkContext.broadcast((centres, known, known_ids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(extend(whole(batch.column("x"), dim, scale), most), root.value[0])
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], ["id", "x", "route", "d"])

    placed = checkpointed(spark, rows.mapInArrow(assign, "id long, x array<double>, route int, d double"))
    directory = spark.sparkContext.broadcast(Directory(centres, _rings(placed, page)))

    def wanted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(floor of each query, row and page of each message)."""
        _, near, near_ids = root.value
        x, ids = whole(batch.column("x"), dim, scale), batch.column("id").to_numpy()
        scores = products(x, near)
        scores[ids[:, None] == near_ids[None]] = _LOW
        floor = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(x), _LOW)
        d = distances(np.hstack([x, np.zeros((len(x), 1))]), directory.value.routes)
        return floor, *directory.value.asked(d, reach(floor, (x * x).sum(axis=1) + most))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks = np.zeros(directory.value.pages, np.int64)
        for batch in batches:
            if batch.num_rows:
                asks += np.bincount(wanted(batch)[2], minlength=len(asks))
        at = np.flatnonzero(asks)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(asks[at])], ["page", "n"])

    asked = checkpointed(spark, rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("x")))
    blocks = np.zeros(directory.value.pages, np.int64)
    for r in asked.mapInArrow(count, "page long, n long").groupBy("page").agg(F.sum("n").alias("n")).collect():  # a number a page
        blocks[r.page] = -(-r.n // block)
    dealt = spark.sparkContext.broadcast(blocks)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                floor, row, page_ = wanted(part)
                ids = part.column("id").to_numpy()
                at = (ids[row].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64) % dealt.value[page_]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), part.column("x").take(pa.array(row)), pa.array(floor[row]), pa.array(page_), pa.array(at)], ["id", "x", "floor", "page", "block"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").to_numpy()
                page_ = directory.value.page(batch.column("route").to_numpy(), batch.column("d").to_numpy(), ids)
                n = dealt.value[page_]
                row = np.repeat(np.arange(len(ids)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), batch.column("x").take(pa.array(row)), pa.array(page_[row]), pa.array(at)], ["id", "x", "page", "block"])

    queries = asked.mapInArrow(send, "id long, x array<double>, floor long, page long, block long")
    pages = placed.mapInArrow(spread, "id long, x array<double>, page long, block long")

    def search(own: pa.Table, asks: pa.Table) -> pa.Table:
        found = [[], [], []]
        if own.num_rows and asks.num_rows:
            own = own.sort_by("id")
            tree = Tree(own["id"].to_numpy(), whole(own["x"], dim, scale), most)
            names = asks["id"].to_numpy()
            ids, scores = tree.search(whole(asks["x"], dim, scale), names, asks["floor"].to_numpy(), k, most)
            row, col = np.nonzero(scores > _LOW)
            found = [names[row], ids[row, col], scores[row, col]]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "id", "score"), found, strict=True)})

    found = pages.groupBy("page", "block").cogroup(queries.groupBy("page", "block")).applyInArrow(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def op7_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op7_mtree_topk": op7_mtree_topk}
SQL = {
    "op7_mtree_topk": f"""
WITH v AS (SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL AND NOT list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding])),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % {EVERY} = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {TOP}
"""
}
