"""Registered queries over exported files and whole screens."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cutledger.operators import payments as pay
from cutledger.plans import reports
from cutledger.plans.registry import Registry
from cutledger.session import shared_path
from cutledger.sources import driver as src
from cutledger.sources import exports as exp

R = Registry()
NOW = dt.datetime(1997, 6, 20, tzinfo=dt.timezone.utc)
LOCAL = "CAST(created_at - INTERVAL 6 HOUR AS DATE)"
NET = "CASE WHEN total_amount > 0 THEN total_amount ELSE amount END"
METHOD = "CASE payment_method WHEN 'card_crc' THEN 'Tarjeta CRC' WHEN 'card_usd' THEN 'Tarjeta USD' ELSE 'SINPE Móvil' END"
STATUS = "CASE status WHEN 'succeeded' THEN 'Exitoso' WHEN 'pending' THEN 'Pendiente' ELSE 'Fallido' END"


def _events_file(s, d):
    path = shared_path(s, "events-csv")
    exp.export_events_csv(src.user_events(s, d), path)
    back = exp.read_csv(s, path)
    return back.select(
        F.col("ID").cast("bigint").alias("id"),
        F.col("Event Type").alias("event_type"),
        F.col("Occurred At").alias("occurred_at"),
        F.col("Country Code").alias("country_code"),
        F.col("Properties").alias("properties"),
    )


R.add(
    "s6_export_events_csv",
    _events_file,
    """SELECT id, event_type, strftime(occurred_at, '%Y-%m-%dT%H:%M:%SZ') AS occurred_at, country_code, properties
    FROM user_events""",
)


def _detail_file(s, d):
    path = shared_path(s, "detail-csv")
    exp.export_payment_detail(pay.reporting_scope(src.payments(s, d)), path)
    back = exp.read_csv(s, path)
    return back.select(
        F.col("ID").cast("bigint").alias("id"),
        F.col("Fecha y Hora").alias("local_time"),
        F.col("Concepto").alias("product"),
        F.col("Método de Pago").alias("method"),
        F.col("Estado").alias("status"),
        F.col("Total Cobrado").cast("double").alias("total"),
        F.col("Código CAByS").alias("code"),
        "currency",
    )


R.add(
    "s7_export_payment_detail",
    _detail_file,
    f"""SELECT id, strftime(created_at - INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time,
      CASE product_description WHEN 'single_download' THEN 'Procesamiento de anidado DXF'
        WHEN 'plan_1_months' THEN 'Suscripción mensual - Plan de 1 mes'
        ELSE 'Suscripción mensual - Plan de ' || substr(product_description, 6, 1) || ' meses' END AS product,
      {METHOD} AS method, {STATUS} AS status, CAST({NET} AS DOUBLE) AS total,
      coalesce(nullif(cabys_code, ''), '8314200000100') AS code, currency FROM payments WHERE superseded_at IS NULL""",
)


def _summary_file(s, d):
    path = shared_path(s, "summary-csv")
    exp.export_daily_summary(pay.reporting_scope(src.payments(s, d)), path)
    back = exp.read_csv(s, path)
    return back.select(
        F.col("Fecha (Día)").alias("day"),
        F.col("Moneda").alias("code"),
        F.col("Método de Pago").alias("method"),
        F.col("Cantidad de Ventas").cast("bigint").alias("n"),
        F.col("Total IVA 13%").cast("double").alias("tax"),
        F.col("Total Neto Cobrado").cast("double").alias("net"),
    )


_WON = "SELECT * FROM payments WHERE superseded_at IS NULL AND status = 'succeeded'"
R.add(
    "s8_export_daily_summary",
    _summary_file,
    f"""SELECT strftime({LOCAL}, '%Y-%m-%d') AS day, upper(currency) AS code, {METHOD} AS method, count(*) AS n,
      CAST(sum(tax_amount) AS DOUBLE) AS tax, CAST(sum({NET}) AS DOUBLE) AS net FROM ({_WON}) GROUP BY 1, 2, 3
    UNION ALL SELECT 'TOTAL ' || upper(currency), upper(currency), '—', count(*), CAST(sum(tax_amount) AS DOUBLE),
      CAST(sum({NET}) AS DOUBLE) FROM ({_WON}) GROUP BY currency""",
)
_VAT = f"""{_WON} AND paid_at >= TIMESTAMP '1997-01-01 06:00:00' AND paid_at < TIMESTAMP '1997-07-01 06:00:00'"""
VAT_PARAMS = {"start_date": "1997-01-01", "end_date": "1997-06-30"}


def _vat_files(s, d):
    path = shared_path(s, "vat-csv")
    scope = reports.vat_scope(src.payments(s, d), VAT_PARAMS, NOW)
    exp.export_vat_form(scope, path, exp.period_label("1997-01-01", "1997-06-30"))
    return exp.read_csv(s, f"{path}/support"), exp.read_csv(s, f"{path}/form")


R.add(
    "s9_vat_support",
    lambda s, d: _vat_files(s, d)[0].select(
        F.col("ID").cast("bigint").alias("id"),
        F.col("Fecha pago").alias("paid"),
        F.col("Subtotal").cast("double").alias("subtotal"),
        F.col("Rubro Form 150").alias("rubric"),
    ),
    f"""SELECT id, strftime(paid_at - INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS paid, CAST(subtotal AS DOUBLE) AS subtotal,
    CASE WHEN currency = 'usd' THEN 'Exentas crédito pleno' ELSE 'Ventas a 13%' END AS rubric FROM ({_VAT})""",
)
R.add(
    "s9_vat_form",
    lambda s, d: _vat_files(s, d)[1].select(
        F.col("Casilla").alias("box"), F.col("Monto").cast("double").alias("amount"), F.col("Período").alias("period")
    ),
    f"""SELECT box, CAST(CASE n WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS DOUBLE) AS amount, '1997-01-01 — 1997-06-30' AS period
    FROM (SELECT coalesce(sum(subtotal) FILTER (currency = 'crc'), 0) AS a, coalesce(sum(tax_amount) FILTER (currency = 'crc'), 0) AS b,
      coalesce(sum(subtotal) FILTER (currency = 'usd'), 0) AS c FROM ({_VAT})), (VALUES (0, 'Total ventas a 13%'),
      (1, 'Monto de impuesto a 13%'), (2, 'Total ventas exentas con derecho a crédito pleno')) AS v(n, box)""",
)


R.add(
    "analytics_dashboard_funnel",
    lambda s, d: reports.analytics_dashboard(
        src.user_events(s, d), src.payments(s, d), src.subscriptions(s, d), src.usages(s, d),
        "2024-01-05", "2024-01-20", "2024-01-20 12:00:00", locale="en",
    )["funnel"].select("event_type", "n"),
    """SELECT g.event_type, coalesce(n, 0) AS n FROM (VALUES ('workspace_started'), ('first_dxf_uploaded'), ('nest_completed'),
      ('paywall_viewed'), ('payment_succeeded'), ('download_completed')) AS g(event_type)
    LEFT JOIN (SELECT event_type, count(*) AS n FROM user_events WHERE locale = 'en' AND occurred_at >= TIMESTAMP '2024-01-05'
      AND occurred_at < TIMESTAMP '2024-01-21' GROUP BY 1) c ON c.event_type = g.event_type""",
)
R.add(
    "sales_report_totals",
    lambda s, d: reports.sales_report(
        src.payments(s, d), {"start_date": "1996-01-01", "end_date": "", "status": ["failed"], "search": "name_1"}, NOW
    )["totals"].select("currency", "n", "total"),
    """SELECT currency, count(*) AS n, CAST(sum(coalesce(nullif(total_amount, 0), amount)) AS DOUBLE) AS total FROM payments
    WHERE superseded_at IS NULL AND status = 'succeeded' AND created_at >= TIMESTAMP '1996-01-01 06:00:00'
    AND contains(lower(purchaser_name), 'name_1') GROUP BY 1""",
)


def _dashboard(table, start, end, at="1996-06-30 12:00:00", **filters):
    return lambda s, d: reports.analytics_dashboard(
        src.user_events(s, d), src.payments(s, d), src.subscriptions(s, d), src.usages(s, d), start, end, at, **filters
    )[table]


_PAID_96 = """payments WHERE superseded_at IS NULL AND paid_at >= TIMESTAMP '1996-01-01' AND paid_at < TIMESTAMP '1997-01-01'"""
R.add(
    "analytics_dashboard_purposes",
    _dashboard("purposes", "1996-01-01", "1996-12-31"),
    f"""SELECT count(*) FILTER (purpose = 'single_download') AS single_count,
      count(*) FILTER (purpose = 'plan_subscription') AS plan_count FROM {_PAID_96} AND status = 'succeeded'""",
)
R.add(
    "analytics_dashboard_plans",
    _dashboard("plans", "1996-01-01", "1996-12-31"),
    f"""SELECT count(*) FILTER (tier_months = 1) AS plans_1_month, count(*) FILTER (tier_months = 2) AS plans_2_month,
      count(*) FILTER (tier_months = 4) AS plans_4_month FROM (SELECT * FROM {_PAID_96} AND status = 'succeeded') p
    JOIN subscriptions s ON s.id = p.subscription_id""",
)
R.add(
    "analytics_dashboard_exhausted_quotas",
    _dashboard("exhausted_quotas", "1996-01-01", "1997-12-31"),
    """SELECT count(*) FILTER (downloads_used >= quota_limit) AS exhausted_quotas FROM usages
    WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1998-01-01'""",
)
R.add(
    "analytics_dashboard_bots",
    _dashboard("bots", "2024-01-05", "2024-01-20", "2024-01-10 12:00:00"),
    """SELECT count(*) AS low_priority_count, count(*) > 300 AS bot_heuristic FROM user_events WHERE priority = 'low'
    AND occurred_at >= TIMESTAMP '2024-01-10 11:00:00' AND occurred_at <= TIMESTAMP '2024-01-10 12:00:00'""",
)
R.add(
    "analytics_dashboard_facets",
    _dashboard("facets", "2024-01-05", "2024-01-20"),
    """SELECT DISTINCT facet, value FROM (SELECT 'locale' AS facet, locale AS value FROM user_events
    UNION ALL SELECT 'payment_method', p_method FROM user_events UNION ALL SELECT 'currency', p_currency FROM user_events)
    WHERE value IS NOT NULL""",
)
R.add(
    "sales_report_statuses",
    lambda s, d: reports.sales_report(
        src.payments(s, d), {"start_date": "1996-01-01", "end_date": "", "status": ["failed"], "search": "name_1"}, NOW
    )["statuses"],
    """SELECT count(*) FILTER (status = 'succeeded') AS succeeded_count, count(*) FILTER (status = 'failed') AS failed_count,
    count(*) FILTER (status = 'pending') AS pending_count FROM payments WHERE superseded_at IS NULL
    AND created_at >= TIMESTAMP '1996-01-01 06:00:00' AND contains(lower(purchaser_name), 'name_1')""",
)
