"""Operators of a few expressions, on their edge cases."""

from pyspark.sql import functions as F

from skein.functions import guards
from skein.operators import episodes, labels, tasks


def test_environment_of_a_process(spark):
    df = spark.createDataFrame([({"PATH": "/bin", "LD_PRELOAD": "x", "PYTHONPATH": "y", "LANG": "C"},), ({},), (None,)], "e map<string, string>")
    assert [r.e for r in df.select(guards.allowed_environment(F.col("e")).alias("e")).collect()] == [{"PATH": "/bin", "LANG": "C"}, {}, None]


def test_messages_without_flags(spark):
    df = spark.createDataFrame([([("user", "a", True, 1)],)], "m array<struct<role: string, content: string, train: boolean, n: int>>")
    assert df.select(labels.without_flags(F.col("m")).alias("m")).first().m[0].asDict() == {"role": "user", "content": "a", "n": 1}
    assert df.select(labels.without_flags(F.col("m"), "n", "train").alias("m")).first().m[0].asDict() == {"role": "user", "content": "a"}


def test_setup_with_defaults(spark):
    setup = spark.createDataFrame([("a", "django", True), ("b", None, False)], "repo string, runner string, editable boolean")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, repo string")
    got = {r.id: (r.runner, r.editable) for r in tasks.with_setup(rows, setup, "repo", {"runner": "pytest", "editable": False}).collect()}
    assert got == {1: ("django", True), 2: ("pytest", False), 3: ("pytest", False), 4: ("pytest", False)}


def test_queues_keep_repeated_rows(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "id int"), spark.createDataFrame([(1,)], "id int")
    assert sorted((r.queue, r.id) for r in tasks.queued(a, b).collect()) == [(0, 1), (0, 1), (0, 2), (1, 1)]
    assert tasks.queued(a).count() == 3 and tasks.queued(a.limit(0), b.limit(0)).collect() == []


def test_keys_in_more_than_one_split(spark):
    df = spark.createDataFrame([("x", "rl"), ("x", "sft"), ("x", "rl"), ("y", "rl"), ("y", "rl"), (None, "rl"), (None, "sft")], "k string, s string")
    assert [tuple(r) for r in tasks.shared_between(df, "s", "k").collect()] == [("x", ["rl", "sft"])]


def test_every_category_is_counted(spark):
    schema = "resolved boolean, error string, status string, valid boolean, test string"
    rows = [(True, None, "submitted", True, "pass"), (False, "CUDA out of memory", "error", False, None), (False, "pip install failed", "error", False, None), (False, None, "budget_exhausted", False, None)]
    kind = episodes.failure_category(F.col("resolved"), F.col("error"), F.col("status"), F.col("valid"), F.col("test"))
    got = {r.category: r.n for r in episodes.category_counts(spark.createDataFrame(rows, schema), kind).collect()}
    assert got == {"resolved": 1, "infrastructure_error": 1, "test_environment_issue": 1, "step_budget_exhaustion": 1, "wrong_file": 0, "incomplete_patch": 0, "policy_error": 0}
    assert set(r.n for r in episodes.category_counts(spark.createDataFrame([], schema), kind).collect()) == {0}
