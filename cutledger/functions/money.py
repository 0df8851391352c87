"""Money columns. Prices are decimal(12,2); stored cents follow the currency's own rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutledger.sources.dims import VAT_RATE


def to_major(cents: Column, currency: Column) -> Column:
    """Stored cents in major units: USD has cents, CRC is stored whole."""
    whole = cents.cast("decimal(14,2)")
    return F.when(currency == "usd", (whole / F.lit(100).cast("decimal(3,0)"))).otherwise(whole).cast("decimal(14,2)")


def to_minor(total: Column, currency: Column) -> Column:
    """Gateway minor units: hundredths for both currencies, half up; other currencies give NULL."""
    return F.when(currency.isin("usd", "crc"), F.round(total * F.lit(100).cast("decimal(3,0)"), 0).cast("bigint"))


def vat(subtotal: Column) -> Column:
    return F.round(subtotal * F.lit(VAT_RATE).cast("decimal(3,2)"), 2).cast("decimal(12,2)")
