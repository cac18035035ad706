"""Keyed writes: first or last row of a key, upsert, retention, merge of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISION_STRENGTH = {"reject": 0, "borderline": 1, "accept": 2}


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order`` (then by its other columns); a partial aggregate, no window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    return df.groupBy(*keys).agg(F.max(packed).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in [*order, *rest])).select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is first by ``order``."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    return df.groupBy(*keys).agg(F.min(packed).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in [*order, *rest])).select(*df.columns)


def upsert(store: DataFrame, batch: DataFrame, key: str, id_col: str, same: list[str]) -> DataFrame:
    """What a batch does to a store: (action, id, key) with action insert, update or skip.

    The first row of a key in the batch wins, an update keeps the stored id, and
    a row whose ``same`` columns equal the stored ones is skipped.
    """
    incoming = first_per_key(batch, [key], [id_col])
    kept = first_per_key(store, [key], [id_col]).select(key, F.col(id_col).alias("_stored"), *(F.col(c).alias(f"_{c}") for c in same))
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return incoming.join(kept, key, "left").select(
        F.when(F.col("_stored").isNull(), "insert").when(equal, "skip").otherwise("update").alias("action"),
        F.coalesce("_stored", id_col).alias("id"),
        key,
    )


def retain_newest(df: DataFrame, order: list[str], keep: int) -> DataFrame:
    """The newest ``keep`` rows: a bounded heap in each task, no global window."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(keep)


#: Processing states that an observation never changes.
TERMINAL_STATES = ("classified", "converted", "fetch_failed", "unsupported_content", "rejected")


def merge_observations(candidates: DataFrame) -> DataFrame:
    """One row for each candidate: its observations folded in the order of ``last_seen_at`` and ``attempt_count``.

    Times widen, attempts grow, query ids are united, the first content hash and
    incident stay.  The stronger decision wins, unless the observation is an
    update of the processing (another state that is not newer, more attempts, or
    another content) and the state so far is not terminal: then its decision
    counts.  A terminal state stays; a retryable one stays until an update.
    Redelivered observations are taken out first, so a candidate's distinct
    observations, not its deliveries, are folded.
    """
    own = ("last_seen_at", "attempt_count", "first_seen_at", "decision", "processing_status", "content_hash", "linked_incident_id")
    seen = candidates.select("candidate_id", *own).distinct()
    strength = F.create_map(*(F.lit(x) for kv in DECISION_STRENGTH.items() for x in kv))
    rank = lambda c: F.coalesce(F.try_element_at(strength, c), F.lit(-1))
    first_held = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    steps = seen.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("steps"))

    def fold(acc, x):
        other = x["processing_status"] != acc["processing_status"]
        new_content = (F.coalesce(x["content_hash"], F.lit("")) != "") & ~x["content_hash"].eqNullSafe(acc["content_hash"])
        update = (other & (x["last_seen_at"] <= acc["last_seen_at"])) | (x["attempt_count"] > acc["attempt_count"]) | new_content
        terminal = acc["processing_status"].isin(*TERMINAL_STATES)
        stays = terminal | ((acc["processing_status"] == "retryable") & ~update)
        stronger = F.when(rank(acc["decision"]) >= rank(x["decision"]), acc["decision"]).otherwise(x["decision"])
        return F.struct(
            F.greatest(acc["last_seen_at"], x["last_seen_at"]).alias("last_seen_at"), F.greatest(acc["attempt_count"], x["attempt_count"]).alias("attempt_count"),
            F.least(acc["first_seen_at"], x["first_seen_at"]).alias("first_seen_at"), F.when(update & ~terminal, x["decision"]).otherwise(stronger).alias("decision"),
            F.when(stays, acc["processing_status"]).otherwise(x["processing_status"]).alias("processing_status"),
            first_held(acc["content_hash"], x["content_hash"]).alias("content_hash"), first_held(acc["linked_incident_id"], x["linked_incident_id"]).alias("linked_incident_id"),
        )

    folded = steps.select("candidate_id", F.aggregate(F.slice("steps", F.lit(2), F.size("steps")), F.get("steps", F.lit(0)), fold).alias("m")).select("candidate_id", "m.*")
    ids = candidates.select("candidate_id", F.explode("query_ids").alias("q")).distinct().groupBy("candidate_id").agg(F.array_sort(F.collect_list("q")).alias("query_ids"))
    return folded.join(ids, "candidate_id", "left")
