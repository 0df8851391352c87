"""Running streams: sources over stored tables, bounded runs, shared folders for state and output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from cutledger.session import ROCKSDB, shared_path

DEFAULT_DELAY = "10 minutes"


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stored parquet table as a stream; the schema is read from the files once."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def finish(writer: DataStreamWriter) -> None:
    """Run over all data available now and stop; raises the stream's error if it failed."""
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


#: Event time of the row that ends a bounded stream.
CLOSES_AT = "9999-01-01 00:00:00"


class Closing:
    """The end of a bounded stream: a source that stays empty until ``end``, and then brings one row later than any other.

    That row moves the watermark past all waiting rows, open windows and timers, and goes no further. A live stream has no such end.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = shared_path(spark, "closing")
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)

    def source(self) -> DataFrame:
        return self.spark.readStream.schema("closes_at timestamp").parquet(self.root)

    def end(self) -> None:
        self.spark.range(1).select(F.lit(CLOSES_AT).cast("timestamp").alias("closes_at")).coalesce(1).write.mode("append").parquet(self.root)


def _blank(kind: T.DataType):
    """Value of the closing row in other columns. Not null, as a join adds filters on null keys that would keep the row from the watermark."""
    if isinstance(kind, T.BooleanType):
        return False
    if isinstance(kind, T.NumericType):
        return 0
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return CLOSES_AT
    return "" if isinstance(kind, (T.StringType, T.BinaryType)) else None


def watermarked(stream: DataFrame, time: str, delay: str, closing: Closing | None = None) -> DataFrame:
    """The stream with a watermark on ``time`` that is ``delay`` behind, and that ``closing`` moves to the end of time.

    Filters on other columns belong before this call: behind it, the optimizer would move them below the watermark, where they would stop the
    closing row.
    """
    if closing is None:
        return stream.withWatermark(time, delay)
    last = closing.source().select(
        *[(F.col("closes_at") if f.name == time else F.lit(_blank(f.dataType))).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    )
    # the filter names the event time, so it stays behind the watermark, which has to see the closing row
    return stream.union(last).withWatermark(time, delay).where(F.coalesce(F.col(time) < F.lit(CLOSES_AT).cast("timestamp"), F.lit(True)))


def drain(stream: DataFrame, label: str, closing: Closing | None = None) -> DataFrame:
    """Append a stream's output to a new table in the shared folder until its input is used up.

    With ``closing`` (the one the stream was built with), event time then goes on to its end: the same stream is resumed from its
    checkpoint over the closing row, so that waiting rows, open windows and timers come out too.
    """
    spark = stream.sparkSession
    root = shared_path(spark, label)
    use_rocksdb(spark)

    def run() -> None:
        finish(
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/state")
        )

    run()
    if closing is not None:
        closing.end()
        run()
    return spark.read.schema(nullable(stream.schema)).parquet(f"{root}/out")


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
