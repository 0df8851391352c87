"""Whole screens as plans: the analytics dashboard and the sales report, each from few scans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.operators import billing as bill
from cutledger.operators import events as ev
from cutledger.operators import payments as pay


def analytics_dashboard(
    events: DataFrame,
    payments: DataFrame,
    subscriptions: DataFrame,
    usage: DataFrame,
    start: str,
    end: str,
    at: str,
    locale: str | None = None,
    payment_method: str | None = None,
    currency: str | None = None,
) -> dict[str, DataFrame]:
    """Tables of the dashboard for the UTC days start..end; each is one lazy plan."""
    shown = ev.filter_events(events, start, end, locale, payment_method, currency)
    paid = pay.in_local_days(pay.reporting_scope(payments), start, end, "paid_at", "UTC")
    if payment_method:
        paid = paid.where(F.col("payment_method") == payment_method)
    if currency:
        paid = paid.where(F.col("currency") == currency)
    return {
        "funnel": ev.funnel(shown),
        "conversion": ev.conversion(shown),
        "purposes": pay.purpose_counts(paid),
        "plans": pay.plans_by_tier(paid, subscriptions),
        "exhausted_quotas": bill.exhausted_quotas(usage, start, end),
        "bots": ev.bot_flag(events, at),
        "facets": ev.facets(events),
    }


def sales_scope(payments: DataFrame, params: dict, now: dt.datetime, column: str = "created_at") -> DataFrame:
    """Payments under the sales filters, without the status filter (totals and counts ignore it)."""
    scope = pay.in_local_days(pay.reporting_scope(payments), *pay.period_bounds(params, now), column)
    return pay.search(pay.where_in(scope, "payment_method", params.get("payment_method")), params.get("search"))


def sales_report(payments: DataFrame, params: dict, now: dt.datetime) -> dict[str, DataFrame]:
    """Totals, status counts and the two listing pages of the sales screen."""
    scope = sales_scope(payments, params, now)
    listed = pay.where_in(scope, "status", params.get("status"))
    pages = {c: params.get(f"{c}_page") or params.get("page") or 1 for c in ("crc", "usd")}
    return {
        "totals": pay.declaration_totals(scope),
        "statuses": pay.status_counts(scope),
        "pages": pay.currency_pages(listed, pages, params.get("direction", "desc")),
    }


def vat_scope(payments: DataFrame, params: dict, now: dt.datetime) -> DataFrame:
    """Payments of the VAT form: by paid time, succeeded ones unless a status is asked for."""
    wanted = [s for s in params.get("status") or [] if s and s.strip()] or ["succeeded"]
    return pay.where_in(sales_scope(payments, params, now, "paid_at"), "status", wanted)
