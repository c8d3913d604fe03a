"""Removal of repeated passages by overlapping three-line windows.

Every three consecutive lines are a window; windows with equal lines (128 bits of hash) are one
passage. The first occurrence, by document id and then position, stays; the lines of every later
one are covered, covered positions merge, and what is covered goes. Each removed line stands, with
its neighbours, at an earlier place too, so no text vanishes from the whole.

Counting is a map-side aggregate, so a window in a third of all documents is one row a task; places
come back by a join that the runtime can split. A document's covered positions are the only rows
gathered by document, never more than its lines.

Null texts have no lines and stay null; texts of fewer than three lines keep all of theirs; an empty
text is one empty line. An id and a text name a document: rows that share both are the same document, rows that share
only the id are different ones, in the order of a hash of their texts; rows without id come last and keep all lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.llm.common import checkpointed, documents

LINES = 3


def _lines(text: str) -> F.Column:
    return F.split(F.col(text), "\n", -1)


def repeated_lines(spark: SparkSession, docs: DataFrame, key: str, text: str, lines: int = LINES) -> DataFrame:
    """(key, _hash, _covered): the positions, from 0, that later occurrences of a window cover in the rows of that id and text hash."""
    at = lambda i: F.get(F.col("_lines"), i)
    split = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_doc"), F.xxhash64(text).alias("_hash"), _lines(text).alias("_lines")).where(F.size("_lines") >= lines)
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("_lines") - lines),
        lambda i: F.struct(F.xxhash64(*(at(i + k) for k in range(lines))).alias("h1"), F.xxhash64(F.lit(lines), *(at(i + k) for k in range(lines))).alias("h2")),
    )
    windows = split.select("_doc", "_hash", F.posexplode(hashed).alias("_pos", "_h")).select("_doc", "_hash", "_pos", "_h.h1", "_h.h2")
    place = F.struct(F.col("_doc").isNull().alias("_none"), "_doc", "_hash", "_pos")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1").select("h1", "h2", "first")
    later = windows.where("_doc IS NOT NULL").join(checkpointed(spark, first), ["h1", "h2"]).where(place != F.col("first"))
    starts = later.groupBy(F.col("_doc").alias(key), "_hash").agg(F.collect_set("_pos").alias("_starts"))
    return starts.select(key, "_hash", F.array_distinct(F.flatten(F.transform("_starts", lambda p: F.sequence(p, p + lines - 1)))).alias("_covered"))


def drop_repeats(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """``docs`` with ``text`` rid of repeated passages, and n_lines, n_removed, which replace columns of those names. A text whose lines all go is empty."""
    names = [c for c in docs.columns if c not in (key, text, "n_lines", "n_removed")]
    rows = docs.select(key, text, F.xxhash64(text).alias("_hash"), *([F.struct(*names).alias("_rest")] if names else []))
    met = rows.join(repeated_lines(spark, docs, key, text, lines), [key, "_hash"], "left").withColumn("_lines", _lines(text))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size("_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_covered"))
    met = met.withColumn("_n", n.cast("long")).withColumn("_removed", F.when(F.col("_covered").isNull(), 0).otherwise(F.size("_covered")).cast("long"))
    cleaned = F.when(F.col("_covered").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n"))
    made = met.withColumn(text, cleaned)
    out = {c: F.col(c) if c in (key, text) else F.col(f"_rest.{c}") for c in docs.columns if c in (key, text) or c in names}
    return made.select(*(v.alias(c) for c, v in out.items()), F.col("_n").alias("n_lines"), F.col("_removed").alias("n_removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return drop_repeats(spark, docs)


QUERIES = {"op6_line_dedup": op6_line_dedup}
SQL = {
    "op6_line_dedup": """
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
windows AS (SELECT doc_id, p, l[p + 1] AS a, l[p + 2] AS b, l[p + 3] AS c FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS p FROM split WHERE len(l) >= 3)),
later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, p + k AS line FROM later, (SELECT unnest([0, 1, 2]) AS k)),
lines AS (SELECT doc_id, line, l[line + 1] AS t FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS line FROM split)),
kept AS (
  SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS text, count(*) AS n FROM lines ANTI JOIN covered USING (doc_id, line) GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines,
  CAST(CASE WHEN s.text IS NULL THEN 0 ELSE len(l) - coalesce(k.n, 0) END AS BIGINT) AS n_removed
FROM split s LEFT JOIN kept k USING (doc_id)
"""
}
