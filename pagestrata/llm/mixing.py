"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share all words; a source's target
stops at three times its words and the rest is shared again by weight, so targets are
min(cap, weight * level) with one level for all. The mix is cut into blocks of ``block`` words. The
sources get blocks by the highest quotients target / (2k + 1), and each source's blocks go to its regions and
a region's to its shards by the same rule over their words. A shard lists its documents in an order drawn from
the seed; whole passes over it come first, then the leading part of one more pass (its last block may end within a document), so nothing
exceeds three times its size and any rerun gives the same rows.

The quotient lists are never built: with divisor d the seats are w / d to the nearest integer and
W / d is within half the number of parties of the total, which leaves about n + 4 candidates in all
to rank. Shards grow in number with their source and a region has about the square root of that number of them, so a
source with a third of all words is many groups, and no group of parties is long.

Rows of one source that share id and text are alike in all that the mix looks at: they are one entry with a number of copies, however many
there are. Null, empty and blank texts have size 0 and take 0; rows with equal ids are separate documents, and rows
without id are drawn by their texts; an empty table gives an empty one. Sources are ranked in one task, a row for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.llm.common import WORD, checkpointed, documents

BLOCK, SHARD_WORDS, SEED = 64, 65_536, "mix-1"
#: A table of sources of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 10_000


def apportion(parties: DataFrame, group: str, party: str, weight: str, seats: str) -> DataFrame:
    """(group, party, blocks): the ``seats`` of each group over its parties by highest quotients, ties to the smaller party."""
    whole = Window.partitionBy(group)
    share = F.col(weight) / F.col("_w")
    parties = parties.where(F.col(weight) > 0).withColumn("_w", F.sum(weight).over(whole)).withColumn("_n", F.count("*").over(whole))
    lo = F.greatest(F.lit(0), F.floor(share * F.col(seats) - share * F.col("_n") / 2 - 2))
    hi = F.ceil(share * F.col(seats) + share * F.col("_n") / 2 + 2)
    parties = parties.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_left", F.col(seats) - F.sum("_lo").over(whole))
    open_ = parties.select(group, party, "_lo", "_left", (F.col(weight)).cast("double").alias("_v"), F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("_k"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.col("_v") / (2 * F.col("_k") + 1)), party))
    return open_.withColumn("_rank", rank).groupBy(group, party).agg((F.first("_lo") + F.count_if(F.col("_rank") <= F.col("_left"))).alias("blocks"))


def source_targets(sized: DataFrame, source: str = "source") -> DataFrame:
    """(source, sid, source_size, target, total): ``sid`` numbers the sources in their order."""
    sums = sized.groupBy(source).agg(F.sum("size").alias("source_size"))
    all_ = Window.partitionBy()
    sums = sums.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last(source)))).withColumn("weight", 1 + (F.col("sid") - 1) % 3)
    sums = sums.withColumn("total", F.sum("source_size").over(all_)).withColumn("cap", 3 * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("rest_weight", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    sums = sums.withColumn("capped", F.col("cap") * F.col("rest_weight") <= F.col("rest") * F.col("weight"))
    free = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(all_), F.lit(0))
    free_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(all_)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * free.cast("double") / free_weight)
    return sums.withColumn("target", target).select(source, "sid", "source_size", "target", "total")


def small(frame: DataFrame) -> DataFrame:
    """The frame, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(frame) if frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else frame


def _draw(key: str, text: str, seed: str) -> F.Column:
    """128 bits of the seed, the id and the text: a document's place in the seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def entries(spark: SparkSession, docs: DataFrame, key: str, text: str, source: str, block: int, seed: str) -> DataFrame:
    """(_id, _source, _draw, size, copies, source_size, target, passes, lead): of each entry, how often it is taken whole, and the words that the last pass takes of its copies together."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.select(F.col(key).alias("_id"), F.col(source).alias("_source"), size.alias("size"), _draw(key, text, seed).alias("_draw"))
    sized = checkpointed(spark, sized.groupBy("_id", "_source", "_draw", "size").agg(F.count("*").alias("copies")))
    sources = checkpointed(spark, source_targets(sized.select("_source", (F.col("size") * F.col("copies")).alias("size")), "_source"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))
    few = sources.withColumn("_shards", shards).withColumn("_width", F.ceil(F.sqrt("_shards"))).select(F.col("_source").alias("_s"), "sid", "source_size", "target", "_shards", "_width")
    placed = sized.join(small(few), F.col("_source").eqNullSafe(F.col("_s")))
    placed = placed.withColumn("_shard", F.conv(F.substring("_draw", 1, 12), 16, 10).cast("long") % F.col("_shards")).withColumn("_region", F.floor(F.col("_shard") / F.col("_width"))).withColumn("_all", F.col("size") * F.col("copies")).drop("_s", "_shards", "_width")

    by_source = apportion(sources.withColumn("_one", F.lit(1)).withColumn("seats", F.floor(F.col("total") / block + 0.5)), "_one", "sid", "target", "seats").select("sid", F.col("blocks").alias("seats"))
    words = checkpointed(spark, placed.groupBy("sid", "_region", "_shard").agg(F.sum("_all").alias("words")))
    by_region = words.groupBy("sid", "_region").agg(F.sum("words").alias("words")).join(by_source, "sid")
    by_region = checkpointed(spark, apportion(by_region, "sid", "_region", "words", "seats").withColumnRenamed("blocks", "seats"))
    by_shard = words.join(by_region, ["sid", "_region"]).withColumn("_group", F.struct("sid", "_region"))
    by_shard = checkpointed(spark, apportion(by_shard, "_group", "_shard", "words", "seats").select(F.col("_group.sid").alias("_sid"), F.col("_shard").alias("_s"), "blocks"))

    inside = Window.partitionBy("sid", "_shard").orderBy("_draw", "_id", "size")
    met = placed.withColumn("_cum", F.sum("_all").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_words", F.sum("_all").over(Window.partitionBy("sid", "_shard")))
    met = met.join(by_shard, (F.col("sid") == F.col("_sid")) & (F.col("_shard") == F.col("_s")), "left")
    quota = F.least(F.coalesce("blocks", F.lit(0)) * block, 3 * F.col("_words"))
    met = met.withColumn("_quota", quota).withColumn("_part", F.when(F.col("_words") > 0, F.col("_quota") % F.col("_words")).otherwise(0))
    passes = F.when(F.col("_words") > 0, (F.col("_quota") - F.col("_part")) / F.col("_words")).otherwise(0).cast("long")
    lead = F.greatest(F.lit(0), F.least(F.col("_all"), F.col("_part") - F.col("_cum") + F.col("_all")))
    return met.select("_id", "_source", "_draw", "size", "copies", "source_size", "target", passes.alias("passes"), lead.cast("long").alias("lead"))


def mix(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """(key, size, source_size, target, taken) for each row."""
    each = entries(spark, docs, key, text, source, block, seed).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    share = F.greatest(F.lit(0), F.least(F.col("size"), F.col("lead") - F.col("_i") * F.col("size")))
    return each.select(F.col("_id").alias(key), "size", "source_size", "target", (F.col("passes") * F.col("size") + share).cast("long").alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, documents(spark, sf_dir))


def take_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, to the nearest whole time; copies of one entry alike."""
    times = F.floor((F.col("passes") * F.col("size") * F.col("copies") + F.col("lead")) / (F.col("size") * F.col("copies")) + 0.5).cast("int")
    taken = entries(spark, docs, "doc_id", "text", "source", BLOCK, SEED).where("size > 0").select("_source", F.col("_draw").alias("_d"), times.alias("_times")).where("_times > 0")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").alias("_from"), _draw("doc_id", "text", SEED).alias("_draw"))
    met = rows.join(taken, (F.col("_draw") == F.col("_d")) & F.col("_from").eqNullSafe(F.col("_source")))
    return met.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


QUERIES = {"op8_mixing": op8_mixing}
SQL = {
    "op8_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
sums AS (
  SELECT *, 1 + (sid - 1) % 3 AS weight, sum(source_size) OVER () AS total, 3 * source_size AS cap
  FROM (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source))),
levels AS (
  SELECT *, total - coalesce(sum(cap) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest_weight
  FROM sums WINDOW w AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, cap * rest_weight <= rest * weight AS capped FROM levels),
sharded AS (
  SELECT source, sid, source_size, total, CASE WHEN capped THEN CAST(cap AS DOUBLE)
    ELSE weight * CAST(total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS DOUBLE) / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target,
    greatest(1, CAST(ceil(source_size / {SHARD_WORDS}.0) AS BIGINT)) AS shards FROM marked),
sources AS (SELECT *, CAST(ceil(sqrt(shards)) AS BIGINT) AS width FROM sharded),
drawn AS (
  SELECT doc_id, size, sid, source_size, target, draw, CAST('0x' || substr(draw, 1, 12) AS BIGINT) % shards AS shard, width
  FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source),
placed AS (SELECT *, shard // width AS region FROM drawn),
p1 AS (
  SELECT *, sum(target) OVER () AS w, count(*) OVER () AS n, CAST(floor(total / {BLOCK}.0 + 0.5) AS BIGINT) AS seats FROM sources WHERE target > 0),
c1 AS (
  SELECT sid, target, lo, unnest(range(lo, hi)) AS k, left_ FROM (
    SELECT *, seats - sum(lo) OVER () AS left_ FROM (
      SELECT *, CAST(greatest(0, floor(target / w * seats - target / w * n / 2 - 2)) AS BIGINT) AS lo, CAST(ceil(target / w * seats + target / w * n / 2 + 2) AS BIGINT) AS hi FROM p1))),
by_source AS (
  SELECT sid, any_value(lo) + count(*) FILTER (r <= left_) AS seats FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, sid) AS r FROM c1) GROUP BY sid),
p2 AS (
  SELECT *, sum(words) OVER g AS w, count(*) OVER g AS n FROM (
    SELECT sid, region, CAST(sum(size) AS DOUBLE) AS words, any_value(seats) AS seats FROM placed JOIN by_source USING (sid) GROUP BY sid, region) WHERE words > 0 WINDOW g AS (PARTITION BY sid)),
c2 AS (
  SELECT sid, region, words, lo, unnest(range(lo, hi)) AS k, left_ FROM (
    SELECT *, seats - sum(lo) OVER (PARTITION BY sid) AS left_ FROM (
      SELECT *, CAST(greatest(0, floor(words / w * seats - words / w * n / 2 - 2)) AS BIGINT) AS lo, CAST(ceil(words / w * seats + words / w * n / 2 + 2) AS BIGINT) AS hi FROM p2))),
by_region AS (
  SELECT sid, region, any_value(lo) + count(*) FILTER (r <= left_) AS seats FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY words / (2 * k + 1) DESC, region) AS r FROM c2) GROUP BY sid, region),
p3 AS (
  SELECT *, sum(words) OVER g AS w, count(*) OVER g AS n FROM (
    SELECT sid, region, shard, CAST(sum(size) AS DOUBLE) AS words, any_value(seats) AS seats FROM placed JOIN by_region USING (sid, region) GROUP BY sid, region, shard) WHERE words > 0 WINDOW g AS (PARTITION BY sid, region)),
c3 AS (
  SELECT sid, region, shard, words, lo, unnest(range(lo, hi)) AS k, left_ FROM (
    SELECT *, seats - sum(lo) OVER (PARTITION BY sid, region) AS left_ FROM (
      SELECT *, CAST(greatest(0, floor(words / w * seats - words / w * n / 2 - 2)) AS BIGINT) AS lo, CAST(ceil(words / w * seats + words / w * n / 2 + 2) AS BIGINT) AS hi FROM p3))),
by_shard AS (
  SELECT sid, shard, any_value(lo) + count(*) FILTER (r <= left_) AS blocks FROM (SELECT *, row_number() OVER (PARTITION BY sid, region ORDER BY words / (2 * k + 1) DESC, shard) AS r FROM c3) GROUP BY sid, shard),
met AS (
  SELECT p.*, sum(size) OVER (PARTITION BY sid, shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum, sum(size) OVER (PARTITION BY sid, shard) AS words, coalesce(blocks, 0) AS blocks
  FROM placed p LEFT JOIN by_shard USING (sid, shard)),
quoted AS (SELECT *, least(blocks * {BLOCK}, 3 * words) AS quota FROM met)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN words > 0 THEN (quota // words) * size + greatest(0, least(size, quota % words - cum + size)) ELSE 0 END AS BIGINT) AS taken
FROM quoted
"""
}
