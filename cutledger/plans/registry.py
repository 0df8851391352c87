"""Shared pieces of the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutledger.plans.oracle import oracle
from cutledger.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, times as text, arrays as JSON: values that print alike in any engine."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, ",")
        out.append(c.alias(f.name))
    return df.select(out)


class Registry:
    """Collects queries with their SQL restatement."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return plain(query(spark, sf_dir))

        self.queries[name] = run
        if sql is not None:
            self.oracles[name] = oracle(sql)
