"""A corpus pipeline of the llm operators: quality, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.  When a stage starts, the result of the one before has
been written, and the scratch tables behind it are deleted.

For all stages: other columns pass through untouched, whatever their names; rows are judged by their own text, so null and
repeated ids change nothing but the order of ties; a null text is a text without words; very long texts are judged whole;
an empty table gives an empty table of the same columns.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontam, jaccard, mixing, quality, tokens
from skein.llm.queries import tokenizer_path
from skein.llm.scratch import checkpoint_root, delete, recorded
from skein.session import ship_package

_BEHIND: dict[str, list[str]] = {}


def stage(f):
    """f as a stage: with the package on the executors, and without the scratch tables of the stage before."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        app = spark.sparkContext.applicationId
        for path in _BEHIND.pop(app, ()):
            delete(spark, path)
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        _BEHIND[app] = paths
        return out

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail; n_chars, where there is one, follows the text.

    Null and empty texts have too few words and go.  Repeated rows are judged alike.
    """
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")  # no other column meets those of the rules
    kept = quality.quality_rules(row).where("kept")
    return kept.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that links at 5 words and a similarity of 0.8.

    Ties of an id (repeated rows, other texts under one id) go by a hash of the text; of equal rows one stays; a null id is
    the last choice.  Documents without words all stay.
    """
    return jaccard.without_near_duplicates(docs, size=5, percent=80)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage within the edit bound of a benchmark item; null and empty texts stay."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: weights 1, 2, 3 by source in turn, at most 3 copies.

    A null source is a source, last in order.  Documents without words are taken 0 times.
    """
    return mixing.mix(docs)


@stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document, read from the token files: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end token alone; null ids come first; repeated rows keep a row each.
    """
    return tokens.token_output(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token output", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of each but the last is written and read again."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, work in STAGES[:-1]:
        path = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
        work(spark, docs, sf_dir).write.parquet(path)
        if written:
            delete(spark, written)
        docs, written = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
