"""Rule scores with an audit trail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base score of each source kind.
BASE_WEIGHTS = {
    "official_recall": 100, "government_investigation": 95, "who_fao": 90, "company_release": 85,
    "major_news": 75, "trade_publication": 65, "unknown": 40, "blog": 20,
}
#: Points per further source and their cap; product, hazard, date, trusted domain, stale, vague; highest unofficial and official score.
PER_SOURCE, SOURCES_CAP, PRODUCT, HAZARD, DATE, TRUSTED, STALE, VAGUE, MOST, OFFICIAL = 5, 15, 4, 4, 2, 5, -10, -10, 99, 100
#: What the audit trail calls each modifier.
LABELS = ("explicit product evidence", "explicit hazard evidence", "explicit date evidence", "trusted-domain override", "stale reporting", "vague reporting")


def base_weight(kind: Column) -> Column:
    weights = F.create_map(*(F.lit(x) for kv in BASE_WEIGHTS.items() for x in kv))
    return F.coalesce(F.try_element_at(weights, kind), F.lit(BASE_WEIGHTS["unknown"]))


def confidence(
    kind: Column, independent: Column, product: Column, hazard: Column, date: Column,
    trusted: Column | None = None, stale: Column | None = None, vague: Column | None = None, official: Column | None = None,
) -> tuple[Column, Column]:
    """(score, reasons) of an incident; an official match is certain, all else ends below it."""
    no = F.lit(False)
    base = base_weight(kind)
    more = F.greatest(independent - 1, F.lit(0))
    bonus = F.least(more * PER_SOURCE, F.lit(SOURCES_CAP))
    score = base + bonus
    reasons = [
        F.concat(F.lit("source kind "), F.coalesce(kind, F.lit("unknown")), F.lit(": base "), base),
        F.when(more > 0, F.concat(more, F.lit(" independent corroborating source(s): +"), bonus)),
    ]
    signs = (product, hazard, date, no if trusted is None else trusted, no if stale is None else stale, no if vague is None else vague)
    for applies, points, label in zip(signs, (PRODUCT, HAZARD, DATE, TRUSTED, STALE, VAGUE), LABELS):
        score = score + F.when(applies, points).otherwise(0)
        reasons.append(F.when(applies, f"{label}: {points:+d}"))
    bounded = F.least(F.greatest(score, F.lit(0)), F.lit(MOST))
    reasons.append(F.when(bounded != score, F.concat(F.lit("unofficial confidence bounded to "), bounded)))
    sure = no if official is None else official
    certain = F.array(F.lit(f"official recall match: score set to {OFFICIAL}"))
    return F.when(sure, OFFICIAL).otherwise(bounded), F.when(sure, certain).otherwise(F.array_compact(F.array(*reasons)))
