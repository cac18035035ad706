"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from brackwater.llm import consolidate, encoding, furniture, history, language, leaks, packing, survivor

QUERIES = {
    "p1_found": survivor.p1_found,
    "p1_records": survivor.p1_records,
    "p1_untimed": survivor.p1_untimed,
    "p2_found": furniture.p2_found,
    "p2_cleaned": furniture.p2_cleaned,
    "p2_near_lines": furniture.p2_near_lines,
    "p4_found": history.p4_found,
    "p4_near_digests": history.p4_near_digests,
    "p5_found": consolidate.p5_found,
    "p7_found": language.p7_found,
    "p7_languages": language.p7_languages,
    "p8_packed": packing.p8_packed,
    "p8_fill": packing.p8_fill,
    "p9_found": leaks.p9_found,
    "p10_found": encoding.p10_found,
}
ORACLES = {
    "p1_found": survivor.P1_SQL, "p1_records": survivor.P1_RECORDS_SQL, "p2_found": furniture.P2_SQL, "p2_cleaned": furniture.P2_CLEANED_SQL,
    "p4_found": history.P4_SQL, "p4_near_digests": history.P4_NEAR_SQL, "p5_found": consolidate.P5_SQL, "p9_found": leaks.P9_SQL,
}
