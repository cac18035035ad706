"""Links of a source ranked by shape and by what lies beside them.

Neighbours are counted by prefix: one partial aggregate for each source and
prefix, joined back on equality; no link is compared with another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackwater.functions import pages, urls


def _beside(links: DataFrame, n: int) -> DataFrame:
    """``links`` (source, url) with ``under``: the other links of the source below the first ``n`` segments."""
    u = F.col("url")
    own, written = pages.prefix(urls.path_parts(u), n), pages.path_start(u, n)
    counts = links.select("source", written.alias("at")).filter("at <> ''").groupBy("source", "at").agg(F.count("*").alias("all"))
    placed = links.withColumn("at", own).join(counts, ["source", "at"], "left")
    return placed.withColumn("under", F.coalesce("all", F.lit(0)) - F.when(F.col("at") == written, 1).otherwise(0)).drop("all", "at")


def hub_points(links: DataFrame) -> DataFrame:
    """``links`` with ``hub``: points for three or more links below the first segment, else below the first two."""
    one = _beside(links, 1).withColumnRenamed("under", "under_one")
    both = _beside(one, 2)
    points = F.when(F.col("under_one") >= pages.HUB_LEAST, F.least("under_one", F.lit(pages.HUB_MOST))).when(
        F.col("under") >= pages.HUB_LEAST, F.least("under", F.lit(pages.HUB_MOST))
    )
    return both.withColumn("hub", F.coalesce(points, F.lit(0))).drop("under", "under_one")


def cluster_points(links: DataFrame) -> DataFrame:
    """``links`` with ``cluster``: points of a probable notice for its neighbours below the first two segments."""
    u = F.col("url")
    found = pages.probable_detail(u) & (F.size(urls.path_parts(u)) >= 2) & (F.col("under") >= pages.CLUSTER_LEAST)
    return _beside(links, 2).withColumn("cluster", F.when(found, F.least("under", F.lit(pages.CLUSTER_MOST))).otherwise(0)).drop("under")


def first_of_source(scored: DataFrame, most: int, score: str = "score") -> DataFrame:
    """(source, rank, url, score): the best ``most`` links of each source, ties by address; a bounded heap in each task."""
    order = Window.partitionBy("source").orderBy(F.desc(score), "url")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("source", "rank", "url", score)


def best_per_url(groups: DataFrame) -> DataFrame:
    """(source, url, score): several ranked groups as one, the highest score of an address kept."""
    return groups.groupBy("source", "url").agg(F.max("score").alias("score"))


def fragment_counts(links: DataFrame) -> DataFrame:
    """(source, fragment, confirmed, probable): how many notices of a source lie under each path fragment."""
    u = F.col("url")
    held = links.select("source", pages.detail(u).alias("sure"), pages.probable_detail(u).alias("likely"), F.explode(pages.fragments(urls.path_parts(u))).alias("fragment"))
    held = held.filter("likely").filter(~F.col("fragment").rlike(pages.ASSET_PATTERN))
    return held.groupBy("source", "fragment").agg(F.count_if("sure").alias("confirmed"), F.count_if(~F.col("sure")).alias("probable"))


def ranked_fragments(counts: DataFrame, column: str) -> DataFrame:
    """(source, fragment, n, rank) of a count: those with two or more where a source has any, else all."""
    held = counts.filter(F.col(column) > 0).select("source", "fragment", F.col(column).alias("n"))
    shared = held.groupBy("source").agg(F.max("n").alias("top"))
    kept = held.join(shared, "source").filter((F.col("top") < 2) | (F.col("n") >= 2))
    return kept.select("source", "fragment", "n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "fragment")).alias("rank"))


def inferred_keywords(links: DataFrame, most: int = 5) -> DataFrame:
    """(source, rank, fragment): at most five path fragments of the notices, confirmed ones before probable ones.

    Where a source has confirmed notices, probable fragments follow only if two
    links or more share them.
    """
    counts = fragment_counts(links)
    sure, likely = ranked_fragments(counts, "confirmed"), ranked_fragments(counts, "probable")
    some = sure.select("source").distinct().withColumn("some", F.lit(True))
    after = (
        likely.join(sure.select("source", "fragment"), ["source", "fragment"], "left_anti").join(some, "source", "left")
        .filter(F.col("some").isNull() | (F.col("n") >= 2)).select("source", "fragment", "rank", F.lit(1).alias("part"))
    )
    both = sure.select("source", "fragment", "rank", F.lit(0).alias("part")).unionByName(after)
    order = Window.partitionBy("source").orderBy("part", "rank")
    return both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("source", F.col("place").alias("rank"), "fragment")


def any_contains(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(text, w))
