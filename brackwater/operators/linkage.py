"""Record linkage without nested loops: every rule is an equi-join on a selective key.

Each rule gives the smallest matching id for a record, never all pairs of a
group, so a key shared by a third of all rows costs one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.runtime import durable


def smallest_partner(keys: DataFrame) -> DataFrame:
    """(id, other_id) for rows (id, key): the smallest other id that shares a key."""
    held = keys.filter(F.col("key").isNotNull() & (F.col("key") != "")).distinct()
    # The two smallest ids of a key answer for all its members.
    two = held.groupBy("key").agg(F.min("id").alias("lo"))
    second = held.join(two, "key").filter(F.col("id") != F.col("lo")).groupBy("key").agg(F.min("id").alias("hi"))
    pair = two.join(second, "key")
    return (
        held.join(pair, "key")
        .groupBy("id")
        .agg(F.min(F.when(F.col("id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))).alias("other_id"))
    )


def link_classes(keys: DataFrame) -> DataFrame:
    """(id, key, class_id, links) for rows (id, key): every class of ids that share a key, a row for each member.

    ``class_id`` is the smallest id of the class and ``links`` the number of its
    other members.  Two ids are linked if and only if they stand in a class of
    one key, so no link is lost although no pairs are made.
    """
    held = keys.filter(F.col("key").isNotNull() & (F.col("key") != "")).distinct()
    classes = held.groupBy("key").agg(F.min("id").alias("class_id"), (F.count("*") - 1).alias("links")).filter("links > 0")
    return held.join(classes, "key").select("id", "key", "class_id", "links")


def contains_tokens(shorter: DataFrame, longer: DataFrame) -> DataFrame:
    """(a, b): all tokens of ``shorter`` (a, tokens) are among those of ``longer`` (b, tokens).

    Only the rarest token of the shorter side is joined, so common words make no
    candidates; the rest is tested on the pair.
    """
    tokens = longer.select("b", F.col("tokens").alias("bt"), F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    rare = (
        shorter.select("a", F.col("tokens").alias("at"), F.explode("tokens").alias("token"))
        .join(counts, "token", "left")
        .groupBy("a")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r"), F.first("at").alias("at"))
        .select("a", "at", F.col("r.token").alias("token"))
    )
    return rare.join(tokens, "token").filter(F.size(F.array_except("at", "bt")) == 0).select("a", "b").distinct()


def name_pairs(names: DataFrame, least: int = 2) -> DataFrame:
    """(left, right) of folded names that count as the same: equal, or the shorter's words all among the longer's.

    Both directions are given.  A contained name needs ``least`` different words; blank names match nothing.
    """
    held = names.toDF("name").filter("name <> ''").distinct()
    tokens = held.select("name", F.array_distinct(F.split("name", " ")).alias("tokens"))
    short = tokens.filter(F.size("tokens") >= least).withColumnRenamed("name", "a")
    inside = contains_tokens(short, tokens.withColumnRenamed("name", "b"))
    return (
        inside.select(F.col("a").alias("left"), F.col("b").alias("right"))
        .unionByName(inside.select(F.col("b").alias("left"), F.col("a").alias("right")))
        .unionByName(held.select(F.col("name").alias("left"), F.col("name").alias("right")))
        .distinct()
    )


def entity_date_pairs(x: DataFrame, days: int = 7) -> DataFrame:
    """(id, other_id, overlap) of all rows (id, product, company, hazard, day) that stand for one matter.

    The names are folded.  Two of product, company and hazard must match, not
    hazard alone; a company's single word is enough beside a matching product.
    The days lie within ``days``; where one is missing, product and company must
    both match.  Pairs of names are made once, from the distinct names, and every
    leg then joins on equality of two names and a block of days, so no pair is lost.
    """
    cut = lambda c, least=2: durable(name_pairs(x.select(c), least))
    product, near, company, hazard = cut("product"), cut("company", 1), cut("company"), cut("hazard")
    right = x.select(F.col("id").alias("other_id"), *(F.col(c).alias(f"r_{c}") for c in ("product", "company", "hazard", "day")))
    block = lambda c: F.floor(F.unix_date(c) / (days + 1))

    def widened(left: DataFrame, *by: tuple[str, DataFrame]) -> DataFrame:
        for c, pairs in by:
            left = left.join(pairs.select(F.col("left").alias(c), F.col("right").alias(f"r_{c}")), c)
        return left

    def dated(*by: tuple[str, DataFrame]) -> DataFrame:
        at = block(F.col("day"))
        left = widened(x.filter("day IS NOT NULL"), *by).withColumn("block", F.explode(F.array(at - 1, at, at + 1)))
        names = [c for c, _ in by]
        there = right.filter("r_day IS NOT NULL").select("other_id", "r_day", *(f"r_{c}" for c in names), block(F.col("r_day")).alias("block"))
        met = left.join(there, [*(f"r_{c}" for c in names), "block"]).filter(within_days(F.col("day"), F.col("r_day"), days))
        return met.select("id", "other_id", F.array(*map(F.lit, names)).alias("names"))

    both = widened(x, ("product", product), ("company", near)).withColumnRenamed("hazard", "l_hazard")
    undated = both.join(right, ["r_product", "r_company"]).filter("day IS NULL OR r_day IS NULL")
    same = hazard.select(F.col("left").alias("l_hazard"), F.col("right").alias("r_hazard"), F.lit("hazard").alias("also"))
    named = F.array_compact(F.array(F.lit("product"), F.lit("company"), F.col("also")))
    undated = undated.join(same, ["l_hazard", "r_hazard"], "left").select("id", "other_id", named.alias("names"))
    legs = (
        dated(("product", product), ("company", near)).unionByName(dated(("product", product), ("hazard", hazard)))
        .unionByName(dated(("company", company), ("hazard", hazard))).unionByName(undated)
    )
    found = legs.filter("id <> other_id").groupBy("id", "other_id").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("n"))
    ordered = F.filter(F.array(*map(F.lit, ("product", "company", "hazard"))), lambda c: F.array_contains("n", c))
    return found.select("id", "other_id", F.array_join(ordered, ",").alias("overlap"))


def within_days(left: Column, right: Column, days: int = 7) -> Column:
    return F.abs(F.datediff(left, right)) <= days


def longest_suffix(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """(host, domain): the longest domain that equals the host or ends it after a dot.

    Hosts are exploded into their suffixes, so the join is on equality.
    """
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 100), "."))
    cut = hosts.select("host").distinct().select("host", F.explode(suffixes).alias("domain"))
    return cut.join(domains.select("domain").distinct(), "domain").groupBy("host").agg(F.max_by("domain", F.length("domain")).alias("domain"))
