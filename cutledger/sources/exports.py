"""Report files: events, payment detail, daily summary, VAT form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutledger.operators import payments as pay

# Column headers of the exported files.
EVENT_COLUMNS = [
    "id", "event_type", "priority", "occurred_at", "user_id", "anonymous_session_key", "tab_id", "project_id",
    "nesting_run_id", "ip", "user_agent", "country_code", "locale", "properties",
]
EVENT_HEADERS = {
    "en": [
        "ID", "Event Type", "Priority", "Occurred At", "User ID", "Anonymous Session Key", "Tab ID", "Project ID",
        "Nesting Run ID", "IP", "User Agent", "Country Code", "Locale", "Properties",
    ],
    "es": [
        "ID", "Tipo de Evento", "Prioridad", "Fecha de Ocurrencia", "ID de Usuario", "Clave de Sesión Anónima",
        "ID de Pestaña", "ID de Proyecto", "ID de Ejecución de Anidado", "IP", "Agente de Usuario", "Código de País",
        "Idioma", "Propiedades",
    ],
}
DETAIL_HEADERS = [
    "ID", "Fecha y Hora", "Usuario ID", "Email Comprador", "Nombre Comprador", "Concepto", "Identificación SINPE",
    "Teléfono SINPE", "Referencia de Compra", "ID Intento de Pago (ONVO)", "Método de Pago", "Estado", "Monto Lista",
    "Descuento", "Subtotal", "Impuesto (IVA 13%)", "Total Cobrado", "Moneda", "Código CAByS",
]
SUMMARY_HEADERS = [
    "Fecha (Día)", "Moneda", "Método de Pago", "Cantidad de Ventas", "Total Precio Lista", "Total Descuento",
    "Total Subtotal (Base Imponible)", "Total IVA 13%", "Total Neto Cobrado",
]
SUPPORT_HEADERS = [
    "Fecha pago", "Método", "Moneda", "Subtotal", "IVA 13%", "Total cobrado", "Referencia", "Email", "Estado", "ID",
    "Rubro Form 150",
]
FORM_HEADERS = ["Casilla", "Monto", "Moneda", "Notas"]
FORM_NOTES = ["Sección I", "Sección I", "Sección I — exportación servicios"]
NO_PERIOD = "Sin filtro de fechas"


def _named(df: DataFrame, values: list[Column], headers: list[str]) -> DataFrame:
    return df.select(*[v.alias(h) for v, h in zip(values, headers, strict=True)])


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _local(column: str) -> Column:
    return F.date_format(F.from_utc_timestamp(column, pay.ZONE), "yyyy-MM-dd HH:mm:ss")


def _write_csv(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').partitionBy(*partitions).csv(path)


def read_csv(spark, path: str) -> DataFrame:
    """An exported file read back, all columns as text."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def events_table(events: DataFrame, locale: str = "en") -> DataFrame:
    """The 14 exported event columns in id order."""
    values = [
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") if c == "occurred_at" else F.col(c) for c in EVENT_COLUMNS
    ]
    return _named(events.orderBy("id"), values, EVENT_HEADERS[locale])


def export_events_csv(events: DataFrame, path: str, locale: str = "en") -> None:
    """Events as CSV; files follow each other in id order whatever the order of the listing."""
    _write_csv(events_table(events, locale), path)


def payment_detail(payments: DataFrame) -> DataFrame:
    """The 19 detail columns plus the currency and time used for layout."""
    values = [
        _text("id"),
        _local("created_at"),
        _text("user_id"),
        _text("purchaser_email"),
        _text("purchaser_name"),
        pay.product_label(F.col("product_description"), F.col("purpose")),
        _text("sinpe_transfer_identification"),
        _text("sinpe_transfer_mobile_number"),
        _text("purchase_reference"),
        _text("onvo_payment_intent_id"),
        pay.method_label(F.col("payment_method")),
        pay.status_label(F.col("status")),
        F.col("list_price"),
        F.col("discount_amount"),
        F.col("subtotal"),
        F.col("tax_amount"),
        pay.net_collected(),
        F.upper("currency"),
        pay.catalog_code(F.col("cabys_code")),
    ]
    return _named(payments, values, DETAIL_HEADERS)


def export_payment_detail(payments: DataFrame, path: str, direction: str = "desc") -> None:
    """Payment detail, one folder per currency, by time within it."""
    turn = F.asc if direction == "asc" else F.desc
    rows = payment_detail(payments.orderBy("currency", turn("created_at"), turn("id")))
    _write_csv(rows.withColumn("currency", F.lower("Moneda")), path, "currency")


def summary_table(payments: DataFrame, direction: str = "desc") -> DataFrame:
    """Daily summary rows of each currency with its TOTAL row last (also for a currency without sales)."""
    spark = payments.sparkSession
    sums = pay.daily_summary_with_total(payments)
    both = spark.createDataFrame([("crc",), ("usd",)], "currency string")
    totals = both.join(sums.where("is_total"), "currency", "left").withColumn("is_total", F.lit(True))
    rows = sums.where("not is_total").unionByName(totals.select(sums.columns))
    turn = F.asc if direction == "asc" else F.desc
    ordered = rows.orderBy("currency", "is_total", turn("day"), turn("payment_method"))
    code = F.upper("currency")
    money = [F.round(F.coalesce(c, F.lit(0).cast("decimal(22,2)")), 2) for c in [*pay.MONEY, "net"]]
    values = [
        F.when(F.col("is_total"), F.concat(F.lit("TOTAL "), code)).otherwise(F.col("day").cast("string")),
        code,
        F.when(F.col("is_total"), "—").otherwise(pay.method_label(F.col("payment_method"))),
        F.coalesce("n", F.lit(0)),
        *money,
    ]
    return _named(ordered, values, SUMMARY_HEADERS)


def export_daily_summary(payments: DataFrame, path: str, direction: str = "desc") -> None:
    """Daily summary per currency as CSV."""
    rows = summary_table(payments, direction)
    _write_csv(rows.withColumn("currency", F.lower("Moneda")), path, "currency")


def vat_support(payments: DataFrame, direction: str = "desc") -> DataFrame:
    """Rows behind the VAT form, by paid time."""
    values = [
        _local("paid_at"),
        pay.method_label(F.col("payment_method")),
        F.upper("currency"),
        F.col("subtotal"),
        F.col("tax_amount"),
        pay.net_collected(),
        _text("purchase_reference"),
        _text("purchaser_email"),
        pay.status_label(F.col("status")),
        _text("id"),
        pay.vat_rubric(),
    ]
    return _named(pay.sort_for_vat(payments, direction), values, SUPPORT_HEADERS)


def period_label(start: str | None, end: str | None) -> str:
    """Text of the form's period; a missing bound is a dash."""
    return NO_PERIOD if not start and not end else f"{start or '—'} — {end or '—'}"


def vat_form(payments: DataFrame, period: str) -> DataFrame:
    """The form's boxes with the period."""
    notes = F.element_at(F.array(*[F.lit(n) for n in FORM_NOTES]), F.col("box_no") + 1)
    boxes = pay.vat_boxes(payments)
    return _named(boxes, [F.col("box"), F.col("amount"), F.col("currency"), notes], FORM_HEADERS).withColumn(
        "Período", F.lit(period)
    )


def export_vat_form(payments: DataFrame, path: str, period: str, direction: str = "desc") -> None:
    """Support rows and form, one folder each."""
    _write_csv(vat_support(payments, direction), f"{path}/support")
    _write_csv(vat_form(payments, period), f"{path}/form")
