"""Registered queries of the operators for language-model training data."""

from __future__ import annotations

from quern.llm import leaks, ledger, mixture, neardup, pairs, personal, sample, visual

QUERIES = {
    "p1_found": ledger.p1_found,
    "p1_records": ledger.p1_records,
    "p2_found": visual.p2_found,
    "p2_forms": visual.p2_forms,
    "p3_sample": sample.p3_sample,
    "p4_found": pairs.p4_found,
    "p4_labels": pairs.p4_labels,
    "p5_found": neardup.p5_found,
    "p6_found": leaks.p6_found,
    "p6_items": leaks.p6_items,
    "p7_mixture": mixture.p7_mixture,
    "p7_shares": mixture.p7_shares,
    "p8_found": personal.p8_found,
    "p8_redacted": personal.p8_redacted,
}

SQL = {
    "p1_found": ledger.P1_FOUND_SQL,
    "p1_records": ledger.P1_RECORDS_SQL,
    "p2_found": visual.P2_FOUND_SQL,
    "p2_forms": visual.P2_FORMS_SQL,
    "p3_sample": sample.P3_SQL,
    "p5_found": neardup.P5_FOUND_SQL,
    "p6_found": leaks.P6_FOUND_SQL,
    "p6_items": leaks.P6_ITEMS_SQL,
}
