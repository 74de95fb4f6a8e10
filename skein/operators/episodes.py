"""Evaluation records: verdicts, rates, taxonomies, behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import ENVIRONMENT, OUT_OF_MEMORY, any_of
from ..functions.stats import mcnemar_log10, wilson
from ..functions.toolcalls import canonical


def _rates(resolved: Column) -> list[Column]:
    n, k = F.count("*"), F.count_if(F.coalesce(resolved, F.lit(False)))
    low, high = wilson(k, n)
    return [
        n.alias("n"), k.alias("resolved"), F.round(F.coalesce(k / F.nullif(n, F.lit(0)), F.lit(0.0)), 6).alias("rate"),
        F.round(low, 6).alias("low"), F.round(high, 6).alias("high"),
    ]


def summary(df: DataFrame, resolved: Column) -> DataFrame:
    return df.agg(*_rates(resolved))


def per_group(df: DataFrame, group: str, resolved: Column) -> DataFrame:
    """Rates with Wilson intervals by group and over all ('*'); a null group is 'unknown'."""
    named = df.select(F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("unknown")).alias(group), resolved.alias("_ok"))
    return named.groupingSets([[group], []], group).agg(*_rates(F.col("_ok")), F.grouping_id().alias("_g")).withColumn(
        group, F.when(F.col("_g") == 0, F.col(group)).otherwise("*")
    ).drop("_g")


def failure_category(resolved, error, status, patch_valid, test_status) -> Column:
    """Why an episode failed; the tests apply in order, those of the error's text only to episodes that ended in one."""
    return (
        F.when(F.coalesce(resolved, F.lit(False)), "resolved")
        .when((status == "error") & any_of(error, ENVIRONMENT), "test_environment_issue")
        .when((status == "error") & any_of(error, OUT_OF_MEMORY), "infrastructure_error")
        .when(status == "error", "policy_error")
        .when(status == "budget_exhausted", "step_budget_exhaustion")
        .when(~F.coalesce(patch_valid, F.lit(False)), "incomplete_patch")
        .when(test_status.isin("timeout", "error"), "test_environment_issue")
        .otherwise("wrong_file")
    )


#: What failure_category says
CATEGORIES = ("resolved", "wrong_file", "incomplete_patch", "test_environment_issue", "infrastructure_error", "step_budget_exhaustion", "policy_error")


def category_counts(df: DataFrame, category: Column) -> DataFrame:
    """(category, n) of every category, those that do not occur with 0."""
    counts = [F.count_if(category == c).alias(c) for c in CATEGORIES]
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in CATEGORIES])
    return df.agg(*counts).select(F.explode(pairs).alias("p")).select("p.*")


def paired(df: DataFrame, treatment: Column, baseline: Column) -> DataFrame:
    """Counts of a paired comparison and the exact McNemar test's log10 p, in one pass."""
    t, b = F.coalesce(treatment, F.lit(False)), F.coalesce(baseline, F.lit(False))
    counts = df.agg(
        F.count("*").alias("n"), F.count_if(t & b).alias("both"), F.count_if(~t & ~b).alias("neither"),
        F.count_if(t & ~b).alias("treatment_only"), F.count_if(~t & b).alias("baseline_only"),
    )
    return counts.withColumn("log10_p", F.round(mcnemar_log10(F.col("treatment_only"), F.col("baseline_only")), 6))


def longest_runs(df: DataFrame, episode: list[str], order: list[str], signature: str) -> DataFrame:
    """The longest run of equal signatures in a row, by gaps and islands; flagged from three on."""
    w = Window.partitionBy(*episode).orderBy(*order)
    runs = df.withColumn("_new", F.when(F.lag(signature).over(w).eqNullSafe(F.col(signature)), 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_new").over(w)).groupBy(*episode, "_run").agg(F.count("*").alias("_n"))
    return runs.groupBy(*episode).agg(F.max("_n").alias("longest_run")).withColumn("repeats", F.col("longest_run") >= 3)


def running_best(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Number of strict new maxima of value by key, and the greatest."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col(value) > F.max(value).over(before), F.lit(True))
    return df.withColumn("_new", new).groupBy(key).agg(F.count_if("_new").alias("n_best"), F.max(value).alias("best"))


def gate(scores: Column, min_delta: float = 0.0, patience: int = 3) -> Column:
    """struct<best, best_index, stop> of an ordered array of scores.

    A score is a new best if it is above the best so far by more than min_delta, which makes the best a state and not a
    running maximum; stop: patience scores in a row brought none (never with a patience of 0).
    """
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(-1).alias("at"), F.lit(0).alias("i"))

    def step(acc, x):
        new = x > acc["best"] + min_delta
        return F.struct(F.when(new, x).otherwise(acc["best"]).alias("best"), F.when(new, acc["i"]).otherwise(acc["at"]).alias("at"), (acc["i"] + 1).alias("i"))

    def finish(acc):
        stop = F.lit(patience > 0) & (acc["i"] - 1 - acc["at"] >= patience)
        return F.struct(acc["best"].alias("best"), acc["at"].alias("best_index"), stop.alias("stop"))

    return F.aggregate(F.transform(scores, lambda x: x.cast("double")), start, step, finish)


def behaviour(calls: DataFrame, episode: list[str], order: list[str], name: str, arguments: str, ids: str | None = None) -> DataFrame:
    """One row over all episodes with calls: tool use, submits, repeated and stuck episodes, reads, completion lengths.

    Calls are rows; a call's signature is its name and canonical arguments.  Episodes without a call have no row and are
    not counted.
    """
    sig = F.concat_ws("\u0001", F.col(name), canonical(F.col(arguments)))
    rows = calls.select(*episode, *order, F.col(name).alias("_name"), F.col(arguments).alias("_args"), sig.alias("_sig"), (F.size(ids) if ids else F.lit(None).cast("int")).alias("_ids"))
    runs = longest_runs(rows, episode, order, "_sig")
    arg = lambda k: F.coalesce(F.get_json_object("_args", f"$.{k}"), F.lit("0"))
    ranged = (F.col("_name") == "read_file") & ~arg("start_line").isin("0", "false", "") & ~arg("end_line").isin("0", "false", "")
    per = rows.groupBy(*episode).agg(
        F.count("*").alias("n"), F.count_distinct("_sig").alias("kinds"), F.count_if(F.col("_name") == "submit").alias("submits"),
        F.count_if(F.col("_name") == "read_file").alias("reads"), F.count_if(ranged).alias("ranged"),
    )
    both = per.join(runs, episode)
    return both.agg(
        F.count("*").alias("episodes"), F.sum("n").alias("calls"), F.sum("submits").alias("submits"), F.count_if(F.col("submits") == 0).alias("never_submit"),
        F.sum("ranged").alias("ranged_reads"), (F.sum("reads") - F.sum("ranged")).alias("whole_reads"), F.count_if("repeats").alias("repeated"),
        F.count_if(F.col("n") >= 4).alias("long"), F.count_if((F.col("n") >= 4) & (F.col("kinds") <= 3)).alias("stuck"),
    )


def arm(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of an arm by a list of ids, one each; raises, when it is read, at an id that the arm lacks."""
    found = ids.select(key).distinct().join(df.withColumn("_here", F.lit(True)), key, "left")
    strict = F.when(F.col("_here").isNull(), F.raise_error(F.concat(F.lit("no record of "), F.col(key).cast("string")))).otherwise(F.col(key))
    return found.withColumn(key, strict).drop("_here")


def paired_arms(treatment: DataFrame, baseline: DataFrame, key: str, order: str, resolved: str) -> DataFrame:
    """The paired comparison of two arms: the last record of each key on either side, over the keys that both have."""
    last = lambda df, name: df.groupBy(key).agg(F.max_by(resolved, order).alias(name))
    return paired(last(treatment, "_t").join(last(baseline, "_b"), key), F.col("_t"), F.col("_b"))


def arm_behaviour(joined: DataFrame, counts: DataFrame) -> DataFrame:
    """behaviour() of an arm whose results and trajectories are two files joined by position (sources.lines.zipped).

    A trajectory is a struct with tool_calls (name, arguments); null ones, and those without calls, are no episodes.  The
    counts of both files, and of the lines that were left over, stand beside.
    """
    calls = joined.select("position", F.posexplode(F.col("right.tool_calls")).alias("call", "c")).select("position", "call", "c.name", "c.arguments")
    return behaviour(calls, ["position"], ["call"], "name", "arguments").join(counts)  # one row each


def evaluation_summary(records: DataFrame) -> DataFrame:
    """One row over evaluation records (resolved, status, patch_valid, steps): counts, rates with their interval, and the mean
    of steps over submitted records that have any (null if none do).  Without records counts and rates are 0."""
    ok, submitted = F.coalesce(F.col("resolved"), F.lit(False)), F.coalesce(F.col("status") == "submitted", F.lit(False))
    valid = F.count_if(F.coalesce(F.col("patch_valid"), F.lit(False))) / F.nullif(F.count("*"), F.lit(0))
    steps = F.round(F.avg(F.when(submitted, F.col("steps"))), 6)
    return records.agg(
        *_rates(ok), F.count_if(submitted).alias("submitted"), F.round(F.coalesce(valid, F.lit(0.0)), 6).alias("valid_rate"), steps.alias("mean_steps")
    )


def supervision(messages: DataFrame, key: str, pos: str, role: str, name: str, text: str) -> DataFrame:
    """One row: trajectories, those with a tool error, and those that submit right after a passing test run.

    name: the tool that a message calls.  Only the first submit of a trajectory counts, and not as its first message.
    """
    before = F.lag(text).over(Window.partitionBy(key).orderBy(pos))
    first = F.row_number().over(Window.partitionBy(key).orderBy(pos)) == 1
    rows = messages.withColumns({"_before": before, "_first": first})
    submit = (F.col(name) == "submit") & ~F.col("_first")
    per = rows.groupBy(key).agg(
        F.coalesce(F.bool_or((F.col(role) == "tool") & F.col(text).startswith("error:")), F.lit(False)).alias("error"),
        F.min_by(F.left("_before", F.lit(32)).contains("status=pass"), F.when(submit, F.col(pos))).alias("passed"),
    )
    return per.agg(F.count("*").alias("trajectories"), F.count_if("error").alias("with_error"), F.count_if(F.coalesce("passed", F.lit(False))).alias("submit_after_pass"))


def error_kinds(messages: DataFrame, role: str, text: str) -> DataFrame:
    """Tool errors by what stands between the first and the second colon."""
    rows = messages.where((F.col(role) == "tool") & F.col(text).startswith("error:"))
    return rows.groupBy(F.trim(F.get(F.split(text, ":"), F.lit(1))).alias("kind")).agg(F.count("*").alias("n"))


def report_text(summary: Column, categories: Column) -> Column:
    """The text report of a summary struct (n, resolved, rate, low, high) and an array of (category, n)."""
    pct = lambda x: F.format_string("%.1f%%", F.bround(x * 100, 1))
    head = F.format_string("tasks %d, resolved %d (%s, 95%% %s to %s)", summary["n"], summary["resolved"], pct(summary["rate"]), pct(summary["low"]), pct(summary["high"]))
    lines = F.transform(F.array_sort(categories, lambda a, b: F.coalesce(F.nullif(F.sign(b["n"] - a["n"]).cast("int"), F.lit(0)), F.when(a["category"] < b["category"], -1).otherwise(1))), lambda c: F.format_string("  %s: %d", c["category"], c["n"]))
    return F.array_join(F.concat(F.array(head), lines), "\n")
