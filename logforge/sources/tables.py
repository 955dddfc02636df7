"""Reading and writing tables: raw CSV logs, Parquet feature tables, small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_raw_csv(spark: SparkSession, path: str, columns: list[str] | None = None, line_feeds: bool = True) -> DataFrame:
    """A raw log: a CSV file or folder with a header, every column as text. Types are applied by rules afterwards, so
    no pass over the data infers them. columns names the header's fields where it is known; else one line is read.

    With line_feeds a quoted field may hold line feeds, and one task reads a whole file: a large log should be many files.
    Without, a file's lines are its rows, and many tasks read a large file."""
    reader = spark.read.option("header", True).option("multiLine", line_feeds).option("quote", '"').option("escape", '"')
    if columns is None:
        columns = reader.option("inferSchema", False).csv(path).columns
    return reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)


def load_raw_csv(spark: SparkSession, path: str, columns: list[str] | None = None, line_feeds: bool = True) -> DataFrame | None:
    """read_raw_csv(), or None where nothing is at the path, in whatever store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at)
    return read_raw_csv(spark, path, columns, line_feeds) if there is not None and len(there) else None


def write_features(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """The final feature table, by day where a partition column is given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file; reports have a row for each column, pair or model, never for each event."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_prepared(df: DataFrame, target: str, leakage: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a prepared table with a label: the label as an integer, without known leakage columns."""
    kept = df.dropna(subset=[target]).drop(*[c for c in leakage if c in df.columns])
    return kept.withColumn(target, F.col(f"`{target}`").cast("int"))
