"""JSON tables that may be missing or damaged, and appended logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files with one JSON object a line; an empty table if there are none, and no rows for damaged records."""
    try:
        lines = spark.read.text(path).filter("trim(value) <> ''")
        parsed = F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
        return lines.select(parsed.alias("r")).filter("r._corrupt is null").select("r.*").drop("_corrupt")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    """Replaces a table of JSON files; readers see the files of a committed job only."""
    df.write.mode("overwrite").json(path)


def append(df: DataFrame, path: str, *by: str) -> None:
    """Adds rows to a Parquet table, in folders by the given columns."""
    df.write.mode("append").partitionBy(*by).parquet(path)
