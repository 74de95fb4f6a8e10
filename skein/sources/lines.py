"""Text files of any size as rows that know their place: line numbers and positions without reading a file in one task.

Spark splits a text file into byte ranges and reads each in order.  A first pass counts the lines of each range; prefix sums
over the ranges of a file, and over files in order of their names, say how many lines stand before each, and a line's place
is that plus its place in the range.  The table of ranges has a row for each split of the input.  It is broadcast up to
BROADCAST_RANGES rows, else joined.

Lines end with a line feed, a carriage return, or both.  Blank lines hold white space alone.  Files must not change between
the passes.  An empty file has no lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_RANGES = 1_000_000
_RANGE = ["file", "start"]


def lines(spark: SparkSession, path: str | list[str], skip_blank: bool = False) -> DataFrame:
    """(file, line_no, position, value): the lines of files (or, with skip_blank, those that are not blank).

    line_no counts from 1 in each file, position from 0 over all files in order of their names.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    rows = rows.where(F.col("value").rlike(r"\S")) if skip_blank else rows
    rows = rows.withColumn("i", F.monotonically_increasing_id())  # ascending by one within a range
    ranges = rows.groupBy(*_RANGE).agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("in_file", F.coalesce(F.sum("n").over(before), F.lit(0)))
    files = ranges.groupBy("file").agg(F.sum("n").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("in_all"))
    ranges = ranges.join(files, "file").select(*_RANGE, "first", "in_file", "in_all")
    small = ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    placed = rows.join(F.broadcast(ranges) if small else ranges, _RANGE)
    line_no = F.col("in_file") + F.col("i") - F.col("first") + 1
    return placed.select("file", line_no.alias("line_no"), (F.col("in_all") + line_no - 1).alias("position"), "value")


def records(spark: SparkSession, path: str | list[str], schema: str, columns: list[str] = ()) -> DataFrame:
    """(path, line_no, fields) of JSON lines, blank ones left out; a line that is no JSON, or lacks one of the columns or has
    it empty, raises with its file and line when it is read."""
    rows = lines(spark, path).where(F.col("value").rlike(r"\S"))
    where = F.concat(F.regexp_replace("file", "^file:/*", "/"), F.lit(":"), F.col("line_no").cast("string"))
    parsed = F.from_json("value", schema)
    fields = spark.createDataFrame([], schema).columns
    broken = F.try_parse_json("value").isNull()
    rows = rows.withColumn("r", F.when(broken, F.raise_error(F.concat(F.lit("invalid JSON at "), where))).otherwise(parsed))
    out = rows.select(F.col("file").alias("path"), "line_no", "r.*")
    for c in columns:
        given = F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
        said = F.concat(F.lit(f"missing {c} at "), F.regexp_replace("path", "^file:/*", "/"), F.lit(":"), F.col("line_no").cast("string"))
        out = out.withColumn(c, F.when(given, F.col(c)).otherwise(F.raise_error(said)))
    return out.select("path", "line_no", *fields)


def zipped(spark: SparkSession, left: str | list[str], right: str | list[str], left_schema: str, right_schema: str) -> tuple[DataFrame, DataFrame]:
    """Two files of JSON lines joined by the place of each line that is not blank, and one row of counts.

    First: (position, left, right), structs that are null where a line holds null or no JSON.  Second: (n_left, n_right,
    n_cut); the shorter file ends the join, and n_cut lines of the longer one are left over.
    """
    a = lines(spark, left, skip_blank=True).select("position", F.from_json("value", left_schema).alias("left"))
    b = lines(spark, right, skip_blank=True).select("position", F.from_json("value", right_schema).alias("right"))
    n_left, n_right = a.agg(F.count("*").alias("n_left")), b.agg(F.count("*").alias("n_right"))
    counts = n_left.join(n_right).select("n_left", "n_right", F.abs(F.col("n_left") - F.col("n_right")).alias("n_cut"))
    return a.join(b, "position"), counts
