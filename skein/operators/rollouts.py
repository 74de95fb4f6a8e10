"""Rewards and group-relative advantages over rollouts, all as windows over the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values
WEIGHTS = {"test_pass": 1.0, "patch_validity": 0.15, "step_penalty": -0.005, "no_submit_penalty": -0.1}


def components(df: DataFrame, resolved: Column, valid: Column, steps: Column, submitted: Column) -> DataFrame:
    b = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    parts = {
        "test_pass": WEIGHTS["test_pass"] * b(resolved),
        "patch_validity": WEIGHTS["patch_validity"] * b(valid),
        "step_penalty": WEIGHTS["step_penalty"] * F.greatest(F.lit(0.0), steps.cast("double")),
        "no_submit_penalty": WEIGHTS["no_submit_penalty"] * (1.0 - b(submitted)),
    }
    return df.withColumns(parts).withColumn("reward", F.col("test_pass") + F.col("patch_validity") + F.col("step_penalty") + F.col("no_submit_penalty"))


def gated_reward(df: DataFrame, group: str, resolved: Column, infra: Column, shaping: str = "gated") -> DataFrame:
    """Shaping terms count only in groups in which a rollout without infra failure resolved the task."""
    if shaping not in ("gated", "always"):
        raise ValueError("shaping must be 'gated' or 'always'")
    base = F.col("test_pass") + F.col("no_submit_penalty")
    shaped = base + F.col("patch_validity") + F.col("step_penalty")
    if shaping == "always":
        return df.withColumn("gated", F.lit(True)).withColumn("train_reward", shaped)
    open_ = F.bool_or(F.coalesce(resolved & ~infra, F.lit(False))).over(Window.partitionBy(group))
    return df.withColumn("gated", open_).withColumn("train_reward", F.when(open_, shaped).otherwise(base))


def advantage(df: DataFrame, group: str, reward: Column, infra: Column, scale: bool = False, eps: float = 1e-8) -> DataFrame:
    """Reward less the mean of the group's rollouts without infra failure, which get 0 themselves; optionally over their
    population standard deviation."""
    w = Window.partitionBy(group)
    mine = F.when(~F.coalesce(infra, F.lit(False)), reward)
    out = mine - F.avg(mine).over(w)
    if scale:
        std = F.stddev_pop(mine).over(w)
        out = F.when(std < eps, 0.0).otherwise(out / (std + eps))
    return df.withColumn("advantage", F.coalesce(out, F.lit(0.0)))


def kl_term(policy: Column, reference: Column) -> Column:
    d = reference - policy
    return F.exp(d) - d - 1


def loss_terms(tokens: DataFrame, sequence: str, policy: str, reference: str, advantage: str, supervised: str, kl_coeff: float = 0.0) -> DataFrame:
    """Per sequence the token-mean policy term, KL term, loss and number of supervised tokens (at least 1 divides)."""
    on = F.col(supervised)
    n = F.greatest(F.count_if(on), F.lit(1))
    pg = -F.sum(F.when(on, F.col(advantage) * F.col(policy)).otherwise(0.0)) / n
    kl = F.sum(F.when(on, kl_term(F.col(policy), F.col(reference))).otherwise(0.0)) / n
    return tokens.groupBy(sequence).agg(F.count_if(on).alias("tokens"), pg.alias("pg"), kl.alias("kl"), (pg + kl_coeff * kl).alias("loss"))


def token_weights(sequences: DataFrame, update: str, tokens: str) -> DataFrame:
    """Each sequence's share of its update's supervised tokens."""
    return sequences.withColumn("scale", F.col(tokens) / F.sum(tokens).over(Window.partitionBy(update)))


def legacy_advantage(df: DataFrame, group: str, reward: Column) -> DataFrame:
    """z-scores of the rewards in a group by the population deviation; 0 where it is under 1e-8."""
    w = Window.partitionBy(group)
    std = F.stddev_pop(reward).over(w)
    return df.withColumn("advantage", F.when(std < 1e-8, 0.0).otherwise((reward - F.avg(reward).over(w)) / std))


def trainable(df: DataFrame, advantage: str, messages: str) -> DataFrame:
    """Rollouts that teach something: with messages and an advantage other than zero."""
    return df.where((F.col(advantage) != 0) & (F.size(F.coalesce(F.col(messages), F.array())) > 0))
