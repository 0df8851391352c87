"""All registered queries, by subject."""

from __future__ import annotations

from cutledger.plans import event_queries, payment_queries, billing_queries, job_queries, inventory_queries, layout_queries, drawing_queries, stream_queries, report_queries

SUBJECTS = [event_queries, payment_queries, billing_queries, job_queries, inventory_queries, layout_queries, drawing_queries, stream_queries, report_queries]


def queries() -> dict:
    return {name: q for m in SUBJECTS for name, q in m.R.queries.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in SUBJECTS for name, sql in m.R.oracles.items()}
