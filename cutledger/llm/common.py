"""What the operators share: reading, writing intermediate tables, word columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutledger.session import shared_path, ship

#: One whitespace-separated word.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes that Spark hands to a Python worker at once: texts are long, so fewer than usual.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def ready(spark: SparkSession) -> None:
    """What the operators with Python functions need of a session."""
    ship(spark)
    for key, value in ARROW.items():
        spark.conf.set(key, value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: a lost executor then costs one re-read. `options` are those of the writer."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(name: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def volume(df: DataFrame, name: str = "text") -> tuple[int, int]:
    """Rows and text bytes of a table: one column-pruned scan, two numbers to the driver."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(name))).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def parts_for(n_bytes: int, each: int, least: int = 12) -> int:
    """Partitions so that one holds about `each` bytes."""
    return max(least, -(-n_bytes // each))


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def in_order(rows: DataFrame, key: str, order: list[Column], fold: Callable, schema: str) -> DataFrame:
    """Fold each key's rows in order: `fold` takes an iterator of rows (tuples without the key) and yields tuples that follow the key.

    Rows stream through sorted partitions, so a key of any size takes one task but no more memory than the fold holds. A null key is a key.
    """
    names = [c for c in rows.columns if c != key]
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))

        made = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

        for value, group in groupby(flat(), key=lambda row: row[0]):
            for result in fold(row[1:] for row in group):
                made.append((value, *result))
                if len(made) >= 5_000:
                    yield out()
                    made = []
        if made:
            yield out()

    return rows.select(key, *names).repartition(key).sortWithinPartitions(F.col(key), *order).mapInArrow(run, schema)
