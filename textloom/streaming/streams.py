"""The line operators over streams: filters and scalar functions as they are, keyed ones with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.clean import short_enough


def read_line_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """Parquet files of lines as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def dedupe_stream(df: DataFrame, key: str = "line", at: str = "loaded_at", delay: str = "7 days") -> DataFrame:
    """First arrival of each key within the watermark; keys older than it leave the state."""
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def clean_stream(df: DataFrame, line: str = "line", limit: int = 2000) -> DataFrame:
    """Stateless filters: valid UTF-8 of at most ``limit`` bytes."""
    return df.where(F.is_valid_utf8(line) & short_enough(F.col(line), limit))


def token_counts_stream(df: DataFrame, line: str = "line", at: str = "loaded_at", window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Lines that hold each token, by window of loading time; late lines count until the watermark."""
    toks = F.explode(F.array_distinct(F.filter(F.split(line, "[\\t-\\r ]+"), lambda x: x != "")))
    return df.withWatermark(at, delay).select(F.window(at, window).alias("w"), toks.alias("token")).groupBy("w", "token").agg(F.count("*").alias("lines"))
