"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact check.

Words are lower-cased and split at white space; shingles are five words (an item with fewer words is one
shingle). An item is compared with the windows of its length, and with the whole of a shorter document. A
window that is moved right until it begins with one of the items' shingles, or until the document ends,
loses none of them, so only windows that begin there are looked at, and of these only the ones that hold
as many of the items' shingles as the threshold asks for: the best window of all is always among them.
Each such window gets a 128-bit SimHash over its shingles with multiplicity. The multi-index has eight blocks of 16 bits and, on the items'
side, every value within two bits of a block: by the pigeonhole principle all pairs at a Hamming distance
of at most 23 meet. Pairs at the threshold are often farther apart, so a window also meets every item of
which it holds one of the rarest shingles, as many of them as a window at the threshold can't all lack;
no pair at the threshold is left out then. What meets is checked by the exact weighted Jaccard similarity of the shingle
multisets, at 0.8 or more.

Windows of equal content are one class from the fingerprint on, so a passage in a third of all
documents is fingerprinted and checked once; equal texts are one text. The benchmark's tables are broadcast only up to
BROADCAST_ROWS rows and joined by shuffle beyond; both joins give the same rows. Findings go back to rows by 128 bits of
the text, so rows without id and rows that share an id are each judged by their own text. Null and blank texts hold nothing; null and blank
items match nothing; an empty benchmark leaves every document clean; equal items are all reported. Other columns take no part.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.llm.common import SPACE, checkpointed, documents

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 16, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BROADCAST_ROWS = 1_000_000


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if it has at most so many rows, and for a join by shuffle otherwise."""
    return frame.hint("broadcast" if frame.limit(rows + 1).count() <= rows else "merge")


def _words(text: str) -> F.Column:
    trimmed = F.btrim(F.lower(F.col(text)), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE))


def _shingles(words: str, k: int) -> F.Column:
    """A 64-bit hash for each position; the last k - 1 have none of their own."""
    at = F.col(words)
    return F.transform(at, lambda w, i: F.xxhash64(w, *(F.get(at, i + j) for j in range(1, k))))


def _tagged(hashes: F.Column) -> F.Column:
    """A multiset as a set: each shingle with its number among its equals."""
    ordered = F.array_sort(hashes)
    return F.transform(ordered, lambda h, i: F.xxhash64(h, i + 1 - F.array_position(ordered, h)))


def _simhash(hashes: str) -> list[F.Column]:
    """Two halves of 64 bits."""

    def half(salt: int) -> F.Column:
        own = F.transform(F.col(hashes), lambda h: F.xxhash64(h, F.lit(salt)))
        bit = lambda b: F.aggregate(own, F.lit(0), lambda n, h: n + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda v, b: F.when(bit(b) > 0, v.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(v))

    return [half(s).alias(f"f{s}") for s in (1, 2)]


def _blocks() -> F.Column:
    parts = [F.shiftrightunsigned(F.col(f), BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int") for f in ("f1", "f2") for i in range(BLOCKS // 2)]
    return F.array(*parts)


def _masks() -> list[int]:
    return [sum(1 << b for b in bits) for r in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), r)]


def _rarest(items: DataFrame, similarity: float) -> DataFrame:
    """(g, item): of each item's shingles the rarest ones, so many that every window at the threshold holds one of them."""
    grams = items.select("item", F.explode(_tagged(F.col("hashes"))).alias("g"))
    own = Window.partitionBy("item")
    grams = grams.join(grams.groupBy("g").agg(F.count("*").alias("df")), "g").withColumn("size", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("df", "g")))
    return grams.where(F.col("rank") <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1).select("g", "item")


def _text_key(text: str) -> list[F.Column]:
    """128 bits of a text: what holds an item is a text, whatever its row's id."""
    return [F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2")]


def _hits(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str, item: str, item_text: str, k: int, similarity: float) -> DataFrame | None:
    """(_t1, _t2, item, first_word, n_words, similarity): an item's best window in each text that holds it; None without items."""
    known = items.select(F.col(item).alias("item"), _words(item_text).alias("w")).where("w is not null").withColumn("n", F.size("w"))
    known = known.withColumn("k", F.least(F.lit(k), F.col("n")))
    sizes = sorted(r[0] for r in known.select("k").distinct().collect())  # 1 to k
    if not sizes:
        return None
    pick = F.coalesce(*(F.when(F.col("k") == s, _shingles("w", s)) for s in sizes))
    known = checkpointed(spark, known.select("item", "n", "k", F.slice(pick, 1, F.greatest(F.lit(0), F.col("n") - F.col("k") + 1)).alias("hashes")))
    known = checkpointed(spark, known.select("*", *_simhash("hashes")))

    marks = checkpointed(spark, known.select("n", "k", F.explode("hashes").alias("h")).distinct())
    marks = small(marks)
    texts = docs.where(F.col(text).isNotNull()).select(*_text_key(text), F.col(text).alias("_text"))
    found = None
    own = F.least("m", "n") - F.col("k") + 1
    need = F.ceil(similarity * (own + F.col("n") - F.col("k") + 1) / (1 + similarity) - 1e-9).cast("int")
    firsts = F.filter("at", lambda p, i: F.get("at", i + need - 1) < p + own)
    starts = F.array_distinct(F.transform(firsts, lambda p: F.least(p, F.greatest(F.lit(0), F.col("m") - F.col("n")))))
    for s in sizes:
        placed = texts.select("_t1", "_t2", _words("_text").alias("w")).where(F.size("w") >= s).withColumn("m", F.size("w"))
        placed = placed.select("_t1", "_t2", "m", F.posexplode(_shingles("w", s)).alias("pos", "h")).where(F.col("pos") <= F.col("m") - s)
        hits = placed.join(marks.where(F.col("k") == s), "h").groupBy("_t1", "_t2", "k", "n", "m").agg(F.array_sort(F.collect_set("pos")).alias("at"))
        hits = hits.select("_t1", "_t2", "k", F.explode(starts).alias("start"), F.least("m", "n").alias("n"))
        found = hits if found is None else found.unionByName(hits)
    found = checkpointed(spark, found.distinct())

    spots = found.groupBy("_t1", "_t2").agg(F.collect_set(F.struct("k", "start", "n")).alias("spots"))
    # Rows of one text are one text from here on, so a text in a third of all rows is looked at once.
    held = texts.join(small(found.select("_t1", "_t2").distinct()), ["_t1", "_t2"], "left_semi").groupBy("_t1", "_t2").agg(F.first("_text").alias("_text"))
    near = held.join(spots, ["_t1", "_t2"]).select("_t1", "_t2", "spots", _words("_text").alias("w")).select("_t1", "_t2", "spots", *(_shingles("w", s).alias(f"h{s}") for s in sizes))
    cut = lambda x: F.coalesce(*(F.when(x["k"] == s, F.slice(F.col(f"h{s}"), x["start"] + 1, x["n"] - s + 1)) for s in sizes))
    windows = near.select("_t1", "_t2", F.explode(F.transform("spots", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), cut(x).alias("hashes")))).alias("x")).select("_t1", "_t2", "x.*")
    windows = checkpointed(spark, windows.withColumn("c1", F.xxhash64("hashes")).withColumn("c2", F.xxhash64(F.lit(1), "hashes")))

    classes = windows.groupBy("c1", "c2").agg(F.first("hashes").alias("hashes"))
    classes = checkpointed(spark, classes.select("*", *_simhash("hashes")))
    keyed = classes.select("c1", "c2", "f1", "f2", F.posexplode(_blocks()).alias("block", "value"))
    masks = F.array(*map(F.lit, _masks()))
    index = known.select("item", F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.posexplode(_blocks()).alias("block", "v")).withColumn("value", F.explode(F.transform(masks, lambda x: x.bitwiseXOR(F.col("v"))))).drop("v")
    far = F.bit_count(F.col("f1").bitwiseXOR(F.col("g1"))) + F.bit_count(F.col("f2").bitwiseXOR(F.col("g2")))
    met = keyed.join(small(index), ["block", "value"]).where(far <= RADIUS).select("c1", "c2", "item")
    rarest = small(checkpointed(spark, _rarest(known, similarity)))
    met = met.unionByName(classes.select("c1", "c2", F.explode(_tagged(F.col("hashes"))).alias("g")).join(rarest, "g").select("c1", "c2", "item")).distinct()
    met = met.join(classes.select("c1", "c2", F.col("hashes").alias("a")), ["c1", "c2"]).join(known.select("item", F.col("hashes").alias("b")), "item")
    met = met.select("c1", "c2", "item", _tagged(F.col("a")).alias("a"), _tagged(F.col("b")).alias("b")).withColumn("both", F.size(F.array_intersect("a", "b")))
    sure = met.select("c1", "c2", "item", (F.col("both") / (F.size("a") + F.size("b") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= similarity)
    best = windows.select("_t1", "_t2", "start", "n", "c1", "c2").join(checkpointed(spark, sure), ["c1", "c2"]).groupBy("_t1", "_t2", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n")).alias("b"))
    return checkpointed(spark, best.select("_t1", "_t2", "item", (-F.col("b.s")).cast("int").alias("first_word"), F.col("b.n").alias("n_words"), F.col("b.similarity").alias("similarity")))


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(key, item, first_word, n_words, similarity): an item's best window in each row that holds it."""
    hits = _hits(spark, docs, items, text, item, item_text, k, similarity)
    keyed = docs.where(F.col(text).isNotNull()).select(key, *_text_key(text))
    if hits is None:
        return keyed.where("false").select(key, F.lit(None).cast(items.schema[item].dataType).alias("item"), F.lit(0).alias("first_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"))
    return keyed.join(small(hits), ["_t1", "_t2"]).select(key, "item", "first_word", "n_words", "similarity")


def mark(spark: SparkSession, docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, contaminated, n_items, items, similarity) for each row; similarity is the best, 0 if clean."""
    rows = docs.select(key, *_text_key(text))
    hits = _hits(spark, docs, items, text, "item_id", "text", SHINGLE, SIMILARITY)
    if hits is None:
        hits = rows.where("false").select("_t1", "_t2", F.lit(None).cast("string").alias("item"), F.lit(0.0).alias("similarity"))
    hits = checkpointed(spark, hits.groupBy("_t1", "_t2").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max("similarity").alias("similarity")))
    return rows.join(small(hits), ["_t1", "_t2"], "left").select(
        key, F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    hits = _hits(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "text", "item_id", "text", SHINGLE, SIMILARITY)
    if hits is None:
        return docs
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), *_text_key("text"))
    hits = checkpointed(spark, hits.select("_t1", "_t2").distinct())
    return keyed.join(small(hits), ["_t1", "_t2"], "left_anti").select("_row.*")


QUERIES = {"op5_decontamination": op5_decontamination}
#: All windows of a text that shares a shingle with some item; any other text has similarity 0 to all.
SQL = {
    "op5_decontamination": f"""
WITH words AS (SELECT doc_id, string_split_regex(t, '{SPACE}') AS w FROM (SELECT doc_id, trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents) WHERE t <> ''),
item_words AS (SELECT item_id, string_split_regex(t, '{SPACE}') AS w FROM (SELECT item_id, trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM benchmark) WHERE t <> ''),
sized AS (SELECT item_id, w, len(w) AS n, least({SHINGLE}, len(w)) AS k FROM item_words),
item_grams AS (SELECT item_id, n, k, array_to_string(w[p + 1:p + k], ' ') AS h FROM (SELECT *, unnest(range(0, n - k + 1)) AS p FROM sized)),
grams AS (SELECT doc_id, m, k, p, array_to_string(w[p + 1:p + k], ' ') AS h FROM (SELECT doc_id, w, len(w) AS m, k, unnest(range(0, len(w) - k + 1)) AS p FROM words, (SELECT DISTINCT k FROM sized))),
near AS (SELECT g.doc_id, g.m, g.k, g.p, g.h FROM grams g SEMI JOIN item_grams USING (k, h)),
own AS (SELECT item_id, any_value(n) AS n, any_value(k) AS k, h, count(*) AS c FROM item_grams GROUP BY item_id, h),
pairs AS (SELECT DISTINCT doc_id, m, item_id, n, k FROM near JOIN item_grams USING (k, h)),
windows AS (SELECT *, unnest(range(0, greatest(0, m - n) + 1)) AS start FROM pairs),
held AS (SELECT w.doc_id, w.item_id, w.m, w.n, w.k, w.start, g.h, count(*) AS c FROM windows w JOIN near g ON g.doc_id = w.doc_id AND g.k = w.k AND g.p BETWEEN w.start AND w.start + w.n - w.k GROUP BY ALL),
met AS (SELECT doc_id, item_id, start, sum(least(a.c, b.c)) AS common, any_value(least(a.m, a.n) - a.k + 1 + a.n - a.k + 1) AS total FROM held a JOIN own b USING (item_id, h) GROUP BY 1, 2, 3),
hits AS (SELECT doc_id, item_id, max(common / (total - common)) AS similarity FROM met WHERE common / (total - common) >= {SIMILARITY} GROUP BY 1, 2),
marked AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items, max(similarity) AS similarity FROM hits GROUP BY 1)
SELECT d.doc_id, m.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items, coalesce(similarity, 0.0::DOUBLE) AS similarity FROM documents d LEFT JOIN marked m USING (doc_id)
"""
}
