"""Command line: clusters a history export and reports on it.

    python -m pagestrata --input history.json [--algo knn|community|kmeans] [--sweep] [--json folder] ...

On a cluster, spark-submit runs the same module with its own master; there --input and --json name shared storage.
"""

from __future__ import annotations

import argparse
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.operators import filtering, reports, vectors
from pagestrata.plans import backfill
from pagestrata.session import session
from pagestrata.sources import history

#: Clusters, sweep rows and noise titles that a report shows; the JSON lines hold everything.
SHOWN, SETTINGS_SHOWN = 25, 5


def options(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("pagestrata", description="Clusters a history export by the meaning of its titles.")
    p.add_argument("--input", default="./history-export.json", help="history export")
    p.add_argument("--algo", choices=("knn", "community", "kmeans"), default="knn")
    p.add_argument("--knn", type=int, default=6, help="neighbours of a page in the mutual graph")
    p.add_argument("--shared", type=int, help="neighbours that two linked pages share; a third of --knn if not given")
    p.add_argument("--threshold", type=float, default=0.35, help="community: least similarity of neighbours")
    p.add_argument("--min-cluster-size", type=int, default=5, help="smaller clusters are noise")
    p.add_argument("--k", type=int, help="kmeans: centres; the root of half the nodes if not given")
    p.add_argument("--min-sim", type=float, default=0.20, help="least similarity of an edge, or to a centre")
    p.add_argument("--dup-threshold", type=float, default=0.97, help="pages at this similarity are one node; above 1 none are")
    p.add_argument("--sweep", action="store_true", help="compare settings instead of clustering once")
    p.add_argument("--list-junk", action="store_true", help="show the most frequent junk titles and stop")
    p.add_argument("--seed", type=int, default=42, help="kmeans: seed of the first centres")
    p.add_argument("--limit", type=int, help="only so many of the newest pages")
    p.add_argument("--no-strip-suffixes", action="store_true", help="keep endings that many titles share")
    p.add_argument("--noise-sample", type=int, default=15, help="noise titles shown")
    p.add_argument("--json", help="folder for the whole clustering as JSON lines")
    p.add_argument("--lock", help="lock file; a second run meanwhile stops")
    found = p.parse_args(argv)
    if found.shared is None:
        found.shared = max(1, found.knn // 3)
    return found


def _clusterer(o: argparse.Namespace):
    def run(spark: SparkSession, nodes: DataFrame) -> DataFrame:
        if o.algo == "community":
            return vectors.community(spark, nodes, o.threshold, o.min_cluster_size)
        if o.algo == "kmeans":
            k = o.k or max(1, round(math.sqrt(nodes.count() / 2)))
            return vectors.kmeans(spark, nodes, k, o.min_sim, o.min_cluster_size, seed=o.seed)
        return vectors.cluster(spark, nodes, vectors.neighbours(nodes, o.knn, o.min_sim), o.knn, o.shared, o.min_sim, o.min_cluster_size)

    return run


def _sweep(spark: SparkSession, nodes: DataFrame, o: argparse.Namespace) -> Iterator[str]:
    found = vectors.sweep(spark, nodes, vectors.neighbours(nodes, 20, 0.2), least=o.min_cluster_size).limit(SETTINGS_SHOWN)
    yield "  ".join(found.columns)
    for row in found.collect():
        yield "  ".join(f"{v:.3f}" if isinstance(v, float) else str(v) for v in row)


def _described(corpus: backfill.Corpus) -> DataFrame:
    """(id, cluster, sim, pos) of every node; noise has no cluster, similarity or place."""
    placed = corpus.nodes.join(corpus.members.where("pos = 0").select(F.col("group").alias("id"), "cluster"), "id", "left")
    return placed.select("id").join(vectors.describe(placed.where("cluster IS NOT NULL")), "id", "left")


def run(spark: SparkSession, o: argparse.Namespace) -> Iterator[str]:
    """The lines of the report, as the work goes on."""
    rows, per_visit = history.read_history(spark, o.input)
    settings = {name: value for name, value in vars(o).items() if name not in ("input", "json", "lock")}
    if o.list_junk:
        found = filtering.filter_visits(rows, per_visit, not o.no_strip_suffixes)
        for r in filtering.samples(found).where("reason = 'junk-title'").orderBy("rank").collect():
            yield f"{r.n:8d}  {r.key}"
        return
    first = (lambda s, nodes: nodes.select("id", F.lit(None).cast("long").alias("cluster"))) if o.sweep else _clusterer(o)
    given = {"per_visit": per_visit, "threshold": o.dup_threshold, "strip": not o.no_strip_suffixes, "newest": o.limit, "clusterer": first}
    corpus = backfill.backfill_once(spark, rows, o.lock, **given) if o.lock else backfill.backfill(spark, rows, **given)

    kept = reports.retention(filtering.reconcile(corpus.found)).first().asDict()
    yield f"source: {'visits' if per_visit else 'items'}"
    yield from (f"{name.replace('_', ' '):24s}{value:>12.1f}" if isinstance(value, float) else f"{name.replace('_', ' '):24s}{value!s:>12s}" for name, value in kept.items())
    if o.sweep:
        yield from _sweep(spark, corpus.nodes, o)
        return
    counts = backfill.summary(corpus).first().asDict()
    yield ", ".join(f"{name.replace('_', ' ')} {value}" for name, value in counts.items())
    nodes = _described(corpus)
    reps = corpus.groups.where("pos = 0").select(F.col("group").alias("id"), F.col("id").alias("rep"))
    by_page = nodes.where("cluster IS NOT NULL").join(reps, "id").select("cluster", F.col("rep").alias("id"), "sim", "pos")
    report = reports.cluster_report(by_page, corpus.pages, corpus.groups).join(corpus.clusters.select(F.col("cluster_id").cast("long").alias("cluster"), "label"), "cluster", "left")
    for r in report.orderBy(F.desc("size"), "cluster").limit(SHOWN).collect():
        yield f"\n{r.label or 'unnamed'}: {r['size']} nodes, {r.visits} visits; {', '.join(r.domains)}"
        yield from (f"    {title}" for title in r.titles)
    noise = nodes.where("cluster IS NULL").join(reps, "id").join(corpus.pages.select(F.col("id").alias("rep"), "title", "last_visit"), "rep").orderBy(F.desc("last_visit"), "rep").limit(o.noise_sample)
    yield from (f"  noise: {r.title}" for r in noise.collect())
    yield "  ".join(f"{stage} {ms / 1000:.2f}s" for stage, ms in corpus.stage_ms.items())
    if o.json:
        facts = {"settings": settings, "stats": kept, "counts": counts}
        reports.clustering_dump(nodes, corpus.groups, corpus.pages, facts).write.mode("overwrite").text(o.json)
        yield f"wrote {o.json}"


def main(argv: list[str] | None = None) -> None:
    o = options(argv)
    spark = SparkSession.getActiveSession() or session("pagestrata", **{"spark.ui.enabled": "false"})
    for line in run(spark, o):
        print(line)


if __name__ == "__main__":
    main()
