"""Names for classes of titles: class-based TF-IDF over words and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.functions import text
from pagestrata.session import checkpointed


def term_scores(titles: DataFrame, longest: int = 4, least: int = 2) -> DataFrame:
    """(class, term, score): of (class, title_id, title). Hot classes are pre-aggregated by term before any shuffle."""
    rows = titles.withColumn("terms", text.terms(F.col("title")))
    terms = rows.select("class", "title_id", F.explode(text.phrases(F.col("terms"), longest)).alias("term"))
    # Written once: totals, document frequencies and scores all read it.
    counts = checkpointed(titles.sparkSession, terms.groupBy("class", "term", "title_id").agg(F.count("*").alias("n")).groupBy("class", "term").agg(F.sum("n").alias("n"), F.count("*").alias("titles")))
    total = counts.groupBy("class").agg(F.sum("n").alias("total"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    sizes = titles.groupBy("class").agg(F.count("*").alias("size"))
    classes = sizes.agg(F.count("*").alias("classes"))
    # Phrases are many times the titles that a plan takes their size from: merge joins, or a table of all phrases may be sent to the driver to be broadcast.
    kept = counts.join(total.join(sizes.hint("merge"), "class").hint("merge"), "class").where(F.col("titles") >= F.least(F.lit(least), F.col("size")))
    kept = kept.join(df.hint("merge"), "term").join(F.broadcast(classes))  # one row
    words = F.size(F.split("term", " "))
    return kept.select("class", "term", (F.col("n") / F.col("total") * F.log(1 + F.col("classes") / F.col("df")) * F.sqrt(words)).alias("score"))


def choose(scores: DataFrame, most: int = 2) -> DataFrame:
    """(class, label, terms): up to ``most`` best terms, each sharing no word with and not within an earlier one; terms are the eight best.

    One aggregation picks each class's best term, a filter drops what clashes with it; no class's terms are gathered.
    """
    left, chosen = scores, None
    for i in range(most):
        pick = left.groupBy("class").agg(F.min(F.struct((-F.col("score")).alias("minus"), "term")).alias("p")).select("class", F.col("p.term").alias(f"t{i}"))
        chosen = pick if chosen is None else chosen.join(pick.hint("merge"), "class", "left")
        t = F.col(f"t{i}")
        clash = F.arrays_overlap(F.split("term", " "), F.split(t, " ")) | F.contains("term", t) | F.contains(t, "term")
        left = left.join(pick.hint("merge"), "class").where(~clash).drop(f"t{i}")
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "term"))
    best = scores.withColumn("rank", rank).where("rank <= 8").groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term", "score"))), lambda x: F.struct(x["term"].alias("term"), x["score"].alias("score"))).alias("terms"))
    return chosen.join(best.hint("merge"), "class").select("class", F.concat_ws(" · ", *(f"t{i}" for i in range(most))).alias("label"), "terms")


def label(titles: DataFrame, most: int = 2, longest: int = 4, least: int = 2) -> DataFrame:
    """A row for each class; classes without terms have a null label."""
    named = choose(checkpointed(titles.sparkSession, term_scores(titles, longest, least)), most)
    return titles.select("class").distinct().join(named.hint("merge"), "class", "left")
