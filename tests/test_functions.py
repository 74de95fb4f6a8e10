import pytest
from pyspark.sql import functions as F

from skein.functions import patch, text
from skein.functions.stats import exclusive_decile, mcnemar_log10, wilson
from skein.operators import episodes, rollouts, tasks
from skein.sources import jsonl


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_wilson_and_mcnemar(spark):
    low, high = wilson(F.lit(3), F.lit(24))
    assert 0.03 < one(spark, low) < 0.06 and 0.28 < one(spark, high) < 0.34
    assert one(spark, wilson(F.lit(0), F.lit(0))[1]) == 1.0
    assert abs(10 ** one(spark, mcnemar_log10(F.lit(1), F.lit(1))) - 1) < 1e-9
    assert abs(10 ** one(spark, mcnemar_log10(F.lit(8), F.lit(1))) - 2 * (1 + 9) / 512) < 1e-12


def test_exclusive_decile(spark):
    assert one(spark, exclusive_decile(F.array(*[F.lit(x) for x in (1, 2, 3, 10)]), 9)) == 13.5


def test_as_list(spark):
    assert one(spark, text.as_list(F.lit('["a","b"]'))) == ["a", "b"]
    assert one(spark, text.as_list(F.lit("plain"))) == ["plain"]
    assert one(spark, text.as_list(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("path,want", [("tests/test_x.py", True), ("conftest.py", True), ("evil.pth", True), ("pkg/thing_test.py", True), ("", True), ("pkg/__init__.py", False), ("django/test/utils.py", False), ("django/test/runner.py", True)])
def test_protected_path(spark, path, want):
    assert one(spark, text.protected_path(F.lit(path))) is want


def test_hunks_and_windows(spark):
    got = one(spark, text.hunk_ranges(F.lit("--- a\n+++ b\n@@ -150,3 +150,4 @@ x\n@@ -7 +8,0 @@")))
    assert [tuple(r) for r in got] == [(150, 152), (7, 7)]
    shown = text.render_window(text.numbered_lines(F.lit("  9: a\n 10: b\nx")), F.lit(9), F.lit(10))
    assert one(spark, shown) == " 9: a\n10: b"


def test_test_ids(spark):
    got = one(spark, text.test_ids(F.lit("t/a.py::x PASSED\nt/a.py::y FAILED [1%]\nERROR t\\b.py")))
    assert got["passed"] == ["t/a.py::x"] and got["failed"] == ["t/a.py::y", "t/b.py"]


def test_patch_application():
    base = "a\nb\nc\nd\n"
    assert patch.apply(base, "--- a/f\n+++ b/f\n@@ -2,2 +2,2 @@\n b\n-c\n+C") == "a\nb\nC\nd\n"
    assert patch.apply("x\n" + base, "@@ -2,2 +2,2 @@\n b\n-c\n+C") == "x\na\nb\nC\nd\n"
    with pytest.raises(ValueError):
        patch.apply(base, "@@ -1,1 +1,1 @@\n-zzz\n+y")
    assert patch.apply("", "@@ -0,0 +1,1 @@\n+y") == "y\n"
    two = "--- a/f\n+++ b/f\n@@ -1 +1 @@\n-a\n+b\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n--- a/h\n+++ b/h\n@@ -1 +1 @@\n-a\n+b"
    assert list(patch.sections(two)) == ["f", "h"]


def test_gated_rewards_and_advantages(spark):
    rows = [("g", True, True, 3, True), ("g", False, True, 10, True), ("g", False, False, 30, False)]
    df = spark.createDataFrame(rows, "g string, ok boolean, valid boolean, steps int, sub boolean").withColumn("infra", F.lit(False))
    df = rollouts.components(df, F.col("ok"), F.col("valid"), F.col("steps"), F.col("sub"))
    got = rollouts.gated_reward(df, "g", F.col("ok"), F.col("infra"))
    assert sorted(round(r.train_reward, 6) for r in got.collect()) == [-0.25, 0.1, 1.135]
    one_infra = spark.createDataFrame([("g", 1.1, False), ("g", 0.0, False), ("g", 0.0, False), ("g", 0.0, True)], "g string, r double, i boolean")
    adv = sorted(r.advantage for r in rollouts.advantage(one_infra, "g", F.col("r"), F.col("i")).collect())
    assert adv == pytest.approx([-1.1 / 3, -1.1 / 3, 0.0, 1.1 - 1.1 / 3])


def test_ledger_and_contamination(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, issue string")
    ledger = spark.createDataFrame([(1, True), (2, False)], "id int, verified boolean")
    assert [r.id for r in tasks.pending(c, ledger, "id", F.col("verified")).collect()] == [3]
    assert sorted(r.id for r in tasks.pending(c, ledger, "id", F.col("verified"), retry=True).collect()) == [2, 3]
    others = spark.createDataFrame([(9, "b"), (8, None)], "id int, issue string")
    assert sorted(r.id for r in tasks.uncontaminated(c, others, [["id"], ["issue"]]).collect()) == [1, 3]


def test_taxonomy(spark):
    kind = episodes.failure_category(F.lit(False), F.lit("CUDA out of memory"), F.lit("error"), F.lit(False), F.lit("error"))
    assert one(spark, kind) == "infrastructure_error"


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "t")
    assert jsonl.read_jsonl(spark, path, "id int").count() == 0
    df = spark.createDataFrame([(1,), (2,)], "id int")
    jsonl.write_once(df, path)
    with pytest.raises(Exception):
        jsonl.write_once(df, path)
    jsonl.append_unseen(spark.createDataFrame([(2,), (3,)], "id int"), path, "id")
    assert sorted(r.id for r in jsonl.read_jsonl(spark, path, "id int").collect()) == [1, 2, 3]


def test_streaming_ledger(spark, tmp_path):
    from skein.streaming.ledger import append_verdicts

    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for ids in ([1, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in ids], "id int").write.mode("append").json(src)
        append_verdicts(spark.readStream.schema("id int").json(src), out, cp, "id").awaitTermination(60)
    assert sorted(r.id for r in spark.read.schema("id int").json(out).collect()) == [1, 2, 3]
