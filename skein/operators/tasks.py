"""Task pools: splits, ledgers, contamination, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import byte_draw, order_key, split_name
from ..functions.text import as_list, slugify

#: Fixed values
SPLITS = {"sft": 60, "rl": 20, "holdout": 20}
PUBLIC = ["task_id", "repo", "repo_url", "base_commit", "version", "issue", "hints", "test_patch", "fail_to_pass", "pass_to_pass", "test_runner", "test_target", "test_k_expr", "venv", "source"]


def assign_split(df: DataFrame, key: Column, widths: dict[str, int] = SPLITS) -> DataFrame:
    return df.withColumn("split", split_name(key, widths))


def draw(df: DataFrame, key: Column, rate: float = 0.25) -> DataFrame:
    return df.where(byte_draw(key, rate))


def dev_slice(df: DataFrame, key: Column, size: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(dev, train): the first min(size, n - 1) rows by seeded hash, and the others.  A top-k, not a global sort."""
    if size <= 0:
        return df.limit(0), df
    keyed = df.withColumn("_o", order_key(key, seed))
    # one row more than asked tells whether train would be empty
    first = keyed.orderBy("_o").limit(size + 1)
    dev = first.withColumn("_n", F.count("*").over(Window.partitionBy())).withColumn("_k", F.row_number().over(Window.orderBy("_o")))
    dev = dev.where("_k <= least(%d, _n - 1)" % size)
    return dev.drop("_o", "_n", "_k"), keyed.join(dev.select("_o"), "_o", "left_anti").drop("_o")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest order of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def pending(candidates: DataFrame, ledger: DataFrame, key: str, verified: Column, retry: bool = False) -> DataFrame:
    """Candidates without a verdict; with retry, also those rejected and never verified."""
    seen = ledger.where(verified) if retry else ledger
    return candidates.join(seen.select(key).distinct(), key, "left_anti")


def public_pool(df: DataFrame, keep: list[str] = PUBLIC) -> DataFrame:
    """Only the columns that a pool may show: what is not on the list, a new gold column too, stays out."""
    return df.select(*[c for c in df.columns if c in keep])


def uncontaminated(subset: DataFrame, others: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Rows of subset that share none of the keys with others: one anti join a key, never one with an OR.

    Keys with a null part match nothing.
    """
    for cols in keys:
        subset = subset.join(others.select(*cols).distinct(), cols, "left_anti")
    return subset


def round_robin(df: DataFrame, group: str, order: Column, n: int) -> DataFrame:
    """One row of each group in turn until there are n; rows past n in a group are pruned before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("rn", rn).where(F.col("rn") <= n).orderBy("rn", group).limit(n)


def shards(df: DataFrame, group: str, order: str, size: int, whole: list[str] | None = None) -> DataFrame:
    """shard number: slices of at most size rows of a group in order; groups in `whole` are never cut."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    cut = F.floor(rn / size)
    return df.withColumn("shard", F.when(F.col(group).isin(*(whole or [])), F.lit(0)).otherwise(cut).cast("long"))


def normalised(raw: DataFrame, source: str) -> DataFrame:
    """Task records from raw instances: renamed, texts never null, test lists as arrays; columns that are absent are null."""
    col = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    text = lambda c: F.coalesce(col(c), F.lit(""))
    listed = lambda c: col(c) if dict(raw.dtypes).get(c, "").startswith("array") else as_list(col(c))
    return raw.select(
        "instance_id", "repo", F.concat(F.lit("https://github.com/"), "repo", F.lit(".git")).alias("repo_url"), "base_commit", col("version").alias("version"),
        text("problem_statement").alias("issue"), text("hints_text").alias("hints"), text("patch").alias("gold_patch"), text("test_patch").alias("test_patch"),
        listed("FAIL_TO_PASS").alias("fail_to_pass"), listed("PASS_TO_PASS").alias("pass_to_pass"), F.lit(source).alias("source"),
    )


def merged_evidence(instances: DataFrame, evidence: DataFrame, key: str, repo: str) -> DataFrame:
    """Pool records: an instance with its verification's columns; a missing venv is the repository's slug."""
    out = instances.join(evidence, key)
    return out.withColumn("venv", F.coalesce(F.nullif(F.col("venv"), F.lit("")), slugify(F.col(repo))))


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """The rows from an offset on, in order, as a top-k."""
    return df.orderBy(*order).offset(offset).limit(limit)


def batches(df: DataFrame, order: Column, size: int, update: int) -> DataFrame:
    """The rows of one update: the first `size` by a hash that changes with the update."""
    return df.orderBy(F.xxhash64(order, F.lit(update)), order).limit(size)


def with_setup(df: DataFrame, setup: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Rows with the setup of their key (a small dimension, a row a key); defaults where the key has none, or a null in it."""
    both = df.join(setup.select(key, *defaults), key, "left")
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def queued(*queues: DataFrame) -> DataFrame:
    """The rows of queues one after another, as bags, with the number of the queue that each is from."""
    numbered = [q.withColumn("queue", F.lit(i)) for i, q in enumerate(queues)]
    out = numbered[0]
    for q in numbered[1:]:
        out = out.unionByName(q)
    return out


def shared_between(df: DataFrame, split: str, key: str) -> DataFrame:
    """(key, splits): keys that stand in more than one split, with the splits in order; no rows if the splits are disjoint."""
    pairs = df.select(key, split).where(F.col(key).isNotNull()).distinct()
    return pairs.groupBy(key).agg(F.array_sort(F.collect_list(split)).alias("splits")).where(F.size("splits") > 1)
