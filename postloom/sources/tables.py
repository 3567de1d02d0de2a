"""Scans and sinks: Parquet, JSON lines, CSV, whole-text documents and small summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CORPUS_SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("message", T.StringType())])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_corpus_csv(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A CSV of (file, message) whose messages hold line breaks and doubled quotes.

    Such a file can't be split, so the rows are spread once after the scan, over ``partitions`` or by size; persist them as Parquet for repeated use.
    """
    df = spark.read.schema(CORPUS_SCHEMA).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return df.repartition(partitions) if partitions else df.hint("rebalance")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, keep_errors: bool = False) -> DataFrame:
    """JSON lines under a fixed schema. Rows whose ``error`` is set are left out unless ``keep_errors``."""
    df = spark.read.schema(schema).json(path)
    return df if keep_errors or "error" not in df.columns else df.filter(F.col("error").isNull())


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row (file, message) for each text file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("message"))


def read_document(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame:
    """One row (file, message) of a text at hand, such as the standard input, or of a file."""
    return spark.createDataFrame([("", text or "")], CORPUS_SCHEMA) if path is None else read_text_files(spark, path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with nulls written out."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def summary_json(df: DataFrame) -> DataFrame:
    """One row, one column ``summary``: the rows of a small aggregate as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("summary"))


def markdown_table(df: DataFrame, max_rows: int = 200) -> str:
    """A report table of a small aggregate. More than ``max_rows`` rows are an error, never cut silently."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a report table of more than {max_rows} rows")
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])
