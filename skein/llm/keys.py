"""One long key a document, ascending as the ids are, for operators that must name documents in small rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise


def with_uid(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, text): uid is the id itself where ids are unique and not null.

    Else it is the rank of (id, nulls first; hash of the text), so rows that repeat id and text share a uid and count as
    one document.  The check reads the id column alone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    clash = rows.groupBy("id").count().where("count > 1 or id is null").limit(1).count()
    if not clash:
        return rows.select(F.col("id").alias("uid"), "id", "text")
    keyed = rows.withColumn("h", F.xxhash64("text"))
    distinct = keyed.select("id", "h").distinct().orderBy(F.col("id").asc_nulls_first(), "h")
    ranked = distinct.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    ranked = materialise(docs.sparkSession.createDataFrame(ranked, "id2 long, h2 long, uid long"), "uids")
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))
    return keyed.join(ranked, same).select("uid", "id", "text")
