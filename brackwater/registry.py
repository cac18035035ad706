"""All queries of the core by name, with their SQL where SQL can express them."""

from __future__ import annotations

from brackwater.plans import crawl, details, fetched, general, incidents, linking, named_rules, payloads, serving, small_rules, written_dates

QUERIES = {**general.QUERIES, **serving.QUERIES, **linking.QUERIES, **details.QUERIES, **crawl.QUERIES, **incidents.QUERIES, **written_dates.QUERIES, **payloads.QUERIES, **fetched.QUERIES, **small_rules.QUERIES, **named_rules.QUERIES}
ORACLES = {**general.ORACLES, **serving.ORACLES, **linking.ORACLES, **details.ORACLES, **crawl.ORACLES, **incidents.ORACLES, **written_dates.ORACLES, **payloads.ORACLES, **fetched.ORACLES, **small_rules.ORACLES, **named_rules.ORACLES}
FLAGSHIP = "ag01_totals"
