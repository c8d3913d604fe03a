"""Near-duplicate documents by SuperMinHash signatures, banding, verification and components.

SuperMinHash gives each element its own random permutation of the signature's components, drawn
step by step, and component i the least (step, uniform) pair that any element has there. Ranks of one
element never meet in a component, which lowers the variance, and once every component has a value
of an earlier step no later step can matter, so long texts stop after a step or two. Steps run for
all texts of a batch at once.

Texts with equal sets are one class and take one row from there on. In each bucket (band) every
class is compared with the bucket's smallest on the full sets. Classes that buckets chain together form
a soup; soups that are then not all connected get an exact second round around a pivot (see
_second_round). No pairs are capped, and a soup of edited copies costs about a pair a class.

With 26 bands of 6 components, a pair at similarity 0.85 meets in some bucket with a chance of
1 - 4.5e-6, and higher pairs with more. Null, empty and blank texts have the empty set: n_shingles 0,
linked with nothing. Rows with equal ids are taken as one document's rows; a row without id is linked with nothing
of its own and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.llm.common import checkpointed, documents, map_batches, pieces
from pagestrata.operators.graph import components
from pagestrata.llm.shingles import distinct, mix, shingle_hashes

BANDS, ROWS, PERCENT = 26, 6, 85
#: The pipeline's stage links at 80; 31 bands of 5 miss a pair at 0.80 with the chance that 26 of 6 have at 0.85.
STAGE_BANDS, STAGE_ROWS, STAGE_PERCENT = 31, 5, 80
#: Bytes of text whose shingles are hashed at once; some ten arrays of 8 bytes for each.
CHUNK = 1 << 20


def superminhash(hashes: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """The n x m signatures; a component is step << 56 | 56 random bits. Rows without elements keep the largest value."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * m, top, np.uint64)
    h, o, drawn = hashes, owner.astype(np.int64), []
    for j in range(m):
        x = mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + (((x >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int16)
        at = k.copy()
        for i in range(j - 1, -1, -1):  # the permutation's entry, traced back through its swaps
            np.copyto(at, i, where=at == drawn[i])
        drawn.append(k)
        np.minimum.at(out, o * m + at, np.uint64(j << 56) | (mix(x ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(8)))
        full = out.reshape(n, m).max(axis=1) < np.uint64((j + 1) << 56)
        left = ~full[o]
        if not left.all():
            h, o = h[left], o[left]
            drawn = [d[left] for d in drawn]
        if not len(h):
            break
    return out.reshape(n, m)


def _bands(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, r::rows][:, :bands])
    return keys.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """(doc, n, fp1, fp2, bands): set size, 128-bit fingerprint of the set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, CHUNK):
                n = part.num_rows
                h, o = distinct(*shingle_hashes(part.column(text), k)[:2])
                size = np.bincount(o, minlength=n)
                prints = []
                for salt in (0x2545F4914F6CDD1D, 0x27D4EB2F165667C5):
                    sums = np.zeros(n, np.uint64)
                    np.add.at(sums, o, mix(h ^ np.uint64(salt)))
                    prints.append(sums.view(np.int64))
                keys = _bands(superminhash(h, o, n, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array(size.astype(np.int64)), *map(pa.array, prints), lists], ["doc", "n", "fp1", "fp2", "bands"])

    return map_batches(docs.select(key, text), run, "doc long, n long, fp1 long, fp2 long, bands array<long>")


def shingle_sets(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(doc, grams): the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, CHUNK):
                h, o = distinct(*shingle_hashes(part.column(text), k)[:2])
                ends = np.searchsorted(o, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["doc", "grams"])

    return map_batches(docs.select(key, text), run, "doc long, grams array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (u, v), those that the full sets link."""
    a, b = sets.toDF("u", "a"), sets.toDF("v", "b")
    met = pairs.join(a, "u").join(b, "v").withColumn("both", F.size(F.array_intersect("a", "b")))
    return met.where(F.col("both") * 100 >= (F.size("a") + F.size("b") - F.col("both")) * percent).select("u", "v")


def _second_round(spark: SparkSession, left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) that are missing between components of one soup: (soup, members, rep, n, component, grams).

    A soup's pivot is its set P nearest to the shingles that at least half of its members have; where no shingle is so
    common, P is the empty set, which nothing is linked with. With D(x) the symmetric
    difference of x and P, that of two sets is that of their D's, and a linked pair differs in at most
    t * (sizes) shingles, t = (100 - percent) / (100 + percent). A set x that isn't linked with P has
    more than t * (|x| + |P|) of them in D(x), so any partner y shares at least
    (|D(x)| + |D(y)| - t * (|x| + |y|)) / 2 > 0. Sets whose part isn't P's (strays) aren't linked with P, but
    their partners may be: all that is known of y is its size, and x shares all of D(x) but t * (|x| + |y|).
    Partners of the other sets are strays, so |D(y)| > t * (|y| + |P|) holds for them. Only shingles in two D's can be shared, which leaves little
    of edited copies, whose edits are mostly their own; a prefix of those, the rare ones first, must meet.
    """
    t = (100 - percent) / (100 + percent)
    common = left.select("soup", "members", F.explode("grams").alias("gram")).groupBy("soup", "gram").agg(F.count("*").alias("df"), F.first("members").alias("members")).where("df * 2 >= members")
    common = checkpointed(spark, common.groupBy("soup").agg(F.collect_list("gram").alias("common")))
    near = left.join(common, "soup").select("soup", F.struct((2 * F.size(F.array_intersect("grams", "common")) - F.col("n")).alias("fit"), (-F.col("rep")).alias("minus"), F.col("n").alias("np")).alias("best"))
    # Small tables of their own here and below: an aggregate in the tasks of a join would keep a large soup in one of them.
    near = checkpointed(spark, near)
    pivots = near.groupBy("soup").agg(F.max("best").alias("best")).select("soup", (-F.col("best.minus")).alias("pivot"), F.col("best.np").alias("np"))
    pivots = checkpointed(spark, pivots.join(sets.toDF("pivot", "pivot_grams"), "pivot"))
    apart = left.join(pivots, "soup", "left").withColumns({"np": F.coalesce("np", F.lit(0)), "pivot_grams": F.coalesce("pivot_grams", F.expr("cast(array() as array<long>)"))})
    apart = apart.withColumn("d", F.concat(F.array_except("grams", "pivot_grams"), F.array_except("pivot_grams", "grams"))).drop("grams", "pivot_grams")
    both = (F.col("n") + F.col("np") - F.size("d")) / 2
    apart = checkpointed(spark, apart.withColumn("linked", both * 100 >= (F.col("n") + F.col("np") - both) * percent).withColumn("size_d", F.size("d")))
    spokes = apart.where("linked and rep <> pivot").select(F.least("pivot", "rep").alias("u"), F.greatest("pivot", "rep").alias("v"))
    main = checkpointed(spark, apart.where("linked").select("soup", "component").distinct().withColumn("main", F.lit(True)))
    # P's own id names all parts that are P's: no other part has it, whatever ids there are.
    apart = apart.join(main, ["soup", "component"], "left").withColumn("stray", F.col("main").isNull()).withColumn("part", F.when(F.col("stray"), F.col("component")).otherwise(F.col("pivot")))

    whole = lambda x: F.ceil(x - 1e-9)
    ratio = 100 / percent
    least = F.greatest(F.lit(1), F.when(F.col("stray"), whole(F.col("size_d") - t * F.col("n") * (1 + ratio))).otherwise(whole((F.col("size_d") + t * (F.col("np") - F.col("n"))) / 2)))
    entries = checkpointed(spark, apart.select("soup", "rep", "n", "part", "stray", "size_d", least.alias("least"), F.explode("d").alias("gram")))
    df = entries.groupBy("soup", "gram").agg(F.count("*").alias("df"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("df > 1 and lo <> hi").select("soup", "gram", "df")
    df = checkpointed(spark, df)
    own = Window.partitionBy("soup", "rep")
    met = entries.join(df, ["soup", "gram"]).withColumn("shared", F.count("*").over(own)).where("shared >= least").withColumn("rank", F.row_number().over(own.orderBy("df", "gram")))
    prefix = checkpointed(spark, met.where("rank <= shared - least + 1").select("soup", "gram", "rep", "n", "part", "stray", "size_d", "shared"))
    a = prefix.where("stray").select("soup", "gram", *(F.col(c).alias(f"{c}_a") for c in ("rep", "n", "part", "size_d", "shared")))
    need = whole((F.col("size_d") + F.col("size_d_a") - t * (F.col("n") + F.col("n_a"))) / 2)
    fits = F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * percent
    pairs = a.join(prefix, ["soup", "gram"]).where((F.col("part") != F.col("part_a")) & fits & (F.least("shared", "shared_a") >= need))
    pairs = pairs.select(F.least("rep", "rep_a").alias("u"), F.greatest("rep", "rep_a").alias("v")).distinct()
    return checkpointed(spark, spokes.unionByName(_verified(pairs, sets, percent)))


def link(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc, n, component) for every row: set size and the smallest id that links lead to."""
    docs = docs.select(key, text)
    signed = checkpointed(spark, signatures(docs, key, text, k, bands, rows))
    classes = checkpointed(spark, signed.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("doc").alias("rep"), F.first("bands").alias("bands")))
    entries = classes.where("rep IS NOT NULL").select("rep", "n", F.explode("bands").alias("bucket"))
    heads = entries.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("head"), F.count("*").alias("c")).where("c > 1").select("bucket", "head")
    shared = checkpointed(spark, entries.join(heads, "bucket").select("bucket", "rep", "n", F.col("head.rep").alias("head"), F.col("head.n").alias("head_n")))

    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    pairs = shared.where("rep <> head").withColumn("m", F.col("head_n")).where(fits).select(F.col("head").alias("u"), F.col("rep").alias("v")).distinct()
    members = shared.select(F.col("rep").alias(key)).distinct()
    sets = checkpointed(spark, shingle_sets(docs.join(members, key, "left_semi"), key, text, k).dropDuplicates(["doc"]))
    edges = checkpointed(spark, _verified(pairs, sets, percent))
    found = components(spark, edges)

    soups = components(spark, shared.where("rep <> head").select(F.col("head").alias("u"), F.col("rep").alias("v")))
    placed = soups.toDF("rep", "soup").join(shared.select("rep", "n").distinct(), "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = placed.groupBy("soup").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("soup", "members")
    left = checkpointed(spark, placed.join(checkpointed(spark, open_), "soup").join(sets.withColumnRenamed("doc", "rep"), "rep"))
    if not left.isEmpty():
        edges = edges.unionByName(_second_round(spark, left, sets, percent))
        found = components(spark, edges)

    by_class = classes.select("fp1", "fp2", "n", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp1", "fp2", "n", F.coalesce("component", "rep").alias("component"))
    by_class = checkpointed(spark, by_class)
    return signed.select("doc", "n", "fp1", "fp2").join(by_class, ["fp1", "fp2", "n"], "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link(spark, documents(spark, sf_dir))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, with its columns, and one row of each id; rows without id stay."""
    kept = link(spark, docs.where("doc_id IS NOT NULL"), percent=STAGE_PERCENT, bands=STAGE_BANDS, rows=STAGE_ROWS).where("doc = component").select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


QUERIES = {"op2_near_dedup": op2_near_dedup}
SQL = {
    "op2_near_dedup": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1:p + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS p FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
sides AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT s.v, r.c FROM reach r JOIN sides s ON r.node = s.u),
found AS (SELECT node AS doc_id, min(c) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM found LEFT JOIN sizes USING (doc_id)
"""
}
