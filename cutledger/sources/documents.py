"""Job documents: run reports, placements, progress, uploaded drawings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutledger.operators.scan import error_list

REPORT = (
    "status string, orphans array<struct<piece_index:int,piece_key:string,reason:string>>, warnings array<string>,"
    " sheets_used int, pieces_count int"
)
PROGRESS = (
    "version int, phase_id string, percent int, message_key string, pieces_total int, pieces_placed int, eta_sec int"
)
PHASES = ["extracting", "fill", "optimizing", "consolidating", "refining", "writing_outputs"]
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
HEAD_BYTES = 1024


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Run reports, one JSON document per file; a malformed document gives NULL fields."""
    return (
        spark.read.schema(REPORT)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(path)
        .withColumn("path", F.input_file_name())
    )


def parse_reports(df: DataFrame, column: str = "report_json") -> DataFrame:
    """The same documents held in a text column."""
    return df.withColumn("report", F.from_json(column, REPORT, {"mode": "PERMISSIVE"}))


def explode_placements(docs: DataFrame) -> DataFrame:
    """One row per placed piece, in sheet and piece order; sheets without pieces give none."""
    sheets = docs.select("run_id", F.posexplode("sheets").alias("sheet_pos", "sheet"))
    return sheets.select(
        "run_id",
        "sheet_pos",
        F.col("sheet.sheet_index").alias("sheet_index"),
        F.col("sheet.width_mm").alias("sheet_width_mm"),
        F.col("sheet.height_mm").alias("sheet_height_mm"),
        F.posexplode("sheet.pieces").alias("piece_pos", "piece"),
    ).select("run_id", "sheet_pos", "sheet_index", "sheet_width_mm", "sheet_height_mm", "piece_pos", "piece.*")


def valid_progress() -> Column:
    """Known version and phase, percent 0..100."""
    return (
        F.col("version").isin(1, 2)
        & F.col("phase_id").isin(PHASES)
        & F.col("percent").isNotNull()
        & F.col("percent").between(0, 100)
    )


def read_progress(df: DataFrame, column: str = "doc") -> DataFrame:
    """Progress documents of versions 1 and 2 as columns; others and malformed ones are dropped."""
    parsed = df.withColumn("_doc", F.from_json(column, PROGRESS)).drop(column)
    rest = [c for c in parsed.columns if c != "_doc"]
    fallback = F.concat(F.lit("nesting.phase."), "phase_id")
    return (
        parsed.select(*rest, "_doc.*")
        .where(valid_progress())
        .withColumn("message_key", F.coalesce(F.nullif("message_key", F.lit("")), fallback))
    )


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with their bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def validate_uploads(files: DataFrame) -> DataFrame:
    """Size, extension and header checks; the header of an oversized file is not looked at."""
    small = F.col("length") <= MAX_UPLOAD_BYTES
    head = F.decode(F.substring("content", 1, HEAD_BYTES), "ISO-8859-1")
    return files.withColumn(
        "errors",
        error_list(
            [
                (~small, "too_large"),
                (~F.lower("path").endswith(".dxf"), "invalid_extension"),
                (small & ~F.coalesce(F.contains(head, F.lit("SECTION")), F.lit(False)), "corrupt_dxf"),
            ]
        ),
    )
