"""JSONL tables: missing files are empty tables; sinks that refuse, append or add unseen keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import lines


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = True) -> DataFrame:
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with their file and line_no, counted over all lines of a file in order; blank lines are skipped.

    A file is read by as many tasks as it has splits.
    """
    table = lines.lines(spark, path).where(F.col("value").rlike(r"\S"))
    return table.select(F.col("file").alias("path"), "line_no", F.from_json(F.trim("value"), schema).alias("r")).select("path", "line_no", "r.*")


def read_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """read_jsonl of a file that must be there."""
    return read_jsonl(spark, path, schema, missing_ok=False)


def read_tasks(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """A task table; a row that lacks one of the columns raises with its file and line when it is read."""
    df = read_numbered(spark, path, schema)
    return require(df, columns, F.concat_ws(":", "path", F.col("line_no").cast("string"))).drop("path", "line_no")


def require(df: DataFrame, columns: list[str], where: Column | None = None) -> DataFrame:
    """df; a row that lacks one of the columns, or has it empty, raises when it is read."""
    for c in columns:
        bad = F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
        said = F.concat(F.lit("" if where is None else " at "), where if where is not None else F.lit(""))
        df = df.withColumn(c, F.when(bad, F.raise_error(F.concat(F.lit(f"missing {c}"), said))).otherwise(F.col(c)))
    return df


def read_instances(spark: SparkSession, path: str, repos: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A Parquet table of raw instances; the filter reaches the scan, and the limit counts the rows that it keeps."""
    df = spark.read.parquet(path)
    df = df.where(F.col("repo").isin(*repos)) if repos else df
    return df.limit(limit) if limit is not None else df


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of all files under a folder; hidden folders are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/") + "/"
    relative = F.substring_index("path", root.split(":", 1)[-1].lstrip("/"), -1)
    return files.select(relative.alias("path"), "length", "content")


def last_checkpoint(paths: DataFrame, path: str = "path") -> DataFrame:
    """The checkpoint folder with the greatest number, by number and not by name."""
    number = F.try_to_number(F.nullif(F.regexp_extract(path, r"checkpoint-(\d+)/?$", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    return paths.where(number.isNotNull()).agg(F.max_by(path, number).alias(path))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write rows and return their number, observed in the same pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return int(seen.get["n"])


def write_once(df: DataFrame, path: str, force: bool = False) -> None:
    df.write.mode("overwrite" if force else "errorifexists").json(path)


def append_unseen(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the target does not have, one a key, and return their number.

    If there is none, the target stays; it is not written again.
    """
    spark = df.sparkSession
    df = df.dropDuplicates([key])
    if exists(spark, path):
        df = df.join(read_jsonl(spark, path, df.schema).select(key).distinct(), key, "left_anti")
    return write_jsonl(df, path, "append")


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary of one row or a few as JSON text in one file."""
    summary.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_aligned(df: DataFrame, key: str, results: list[str], trajectory: str, results_path: str, trajectory_path: str) -> None:
    """Results and trajectories as two tables that share a key; a missing trajectory is a null row, so both have all keys."""
    df.select(key, *[c for c in results if c != key]).write.mode("overwrite").json(results_path)
    df.select(key, trajectory).write.mode("overwrite").option("ignoreNullFields", False).json(trajectory_path)
