"""Row checks, broken links and duplicate keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutledger.operators.scan import error_list
from cutledger.sources import dims
from cutledger.sources.schemas import LINKS


def _not(condition: Column) -> Column:
    """True where the condition is false or NULL."""
    return ~F.coalesce(condition, F.lit(False))


def row_rules(table: str) -> list[tuple[Column, str]]:
    """Range rules of a table as (violated condition, name)."""
    c = F.col
    return {
        "projects": [
            (F.coalesce(F.trim("title"), F.lit("")) == "", "title"),
            (_not(c("kerf_mm") >= 0), "kerf_mm"),
            (_not(c("margin_mm") >= 0), "margin_mm"),
            (_not(c("sheet_gap_mm") >= 0), "sheet_gap_mm"),
            (_not(c("curve_tolerance_mm") > 0), "curve_tolerance_mm"),
        ],
        "sheet_stocks": [
            (_not(c("width_mm") > 0), "width_mm"),
            (_not(c("height_mm") > 0), "height_mm"),
            (c("quantity") < 1, "quantity"),
            (_not(c("sort_order") >= 0), "sort_order"),
        ],
        "subscriptions": [
            (_not(c("tier_months").isin(dims.TIERS)), "tier_months"),
            (c("starts_at").isNull(), "starts_at"),
            (_not(c("ends_at") > c("starts_at")), "ends_at"),
        ],
        "plan_monthly_usages": [
            (c("period_year").isNull(), "period_year"),
            (c("period_month").isNull(), "period_month"),
            (_not((c("downloads_used") >= 0) & (c("downloads_used") <= c("quota_limit"))), "downloads_used"),
            (_not(c("quota_limit") > 0), "quota_limit"),
        ],
    }[table]


def validate_rows(df: DataFrame, table: str) -> DataFrame:
    """Names of the violated rules per row."""
    return df.withColumn("errors", error_list(row_rules(table)))


def broken_links(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose link points at a missing parent, over every declared link between the given tables."""
    found = []
    for child, column, parent in LINKS:
        if child not in tables or parent not in tables:
            continue
        own = F.col("id") if "id" in tables[child].columns else F.lit(None).cast("bigint")
        links = tables[child].where(F.col(column).isNotNull()).select(
            F.lit(child).alias("child"), F.lit(column).alias("link"), own.alias("child_id"), F.col(column).alias("missing_id")
        )
        found.append(links.join(tables[parent].select(F.col("id").alias("missing_id")), "missing_id", "left_anti"))
    return reduce(DataFrame.unionByName, found)


def duplicate_keys(df: DataFrame, keys: list[str], where: str | None = None) -> DataFrame:
    """Key values held by more than one row; ``where`` limits a partial key."""
    scope = df.where(where) if where else df
    return scope.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
