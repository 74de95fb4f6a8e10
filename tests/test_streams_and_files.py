"""Episodes from tables and streams, ledgers under several writers, files whose lines know their place."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import toolcalls  # noqa: F401
from skein.operators import episodes, labels, transcripts
from skein.sources import jsonl, lines
from skein.streaming.episodes import outcome_stream, outcomes
from skein.streaming.snapshots import Conflict, Ledger, pending

rnd = random.Random(23)
KINDS = ["call", "call", "call", "malformed", "submit", "error"]


def fold(kinds, max_steps, max_malformed=2):
    steps = malformed = 0
    for kind in kinds[:max_steps]:
        if kind == "malformed":
            malformed += 1
            if malformed > max_malformed:
                return steps, malformed, "error"
        elif kind == "error":
            return steps, malformed, "error"
        else:
            steps += 1
            if kind == "submit":
                return steps, malformed, "submitted"
    return steps, malformed, "budget_exhausted"


EPISODES = {i: [rnd.choice(KINDS if i % 3 else KINDS[:4]) for _ in range(rnd.randrange(1, 14))] for i in range(40)}


def test_outcomes_of_a_table(spark):
    rows = [(k, i * 3, kind) for k, v in EPISODES.items() for i, kind in enumerate(v)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, at int, kind string")
    got = {r.k: (r.steps, r.malformed, r.status) for r in outcomes(df, "k", "at", "kind", 6).collect()}
    assert got == {k: fold(v, 6) for k, v in EPISODES.items()}
    assert outcomes(df.limit(0), "k", "at", "kind", 6).collect() == []
    assert "WindowGroupLimit" in outcomes(df, "k", "at", "kind", 6)._jdf.queryExecution().executedPlan().toString()


def test_outcomes_of_a_stream_restarted_in_mid_episode(spark, tmp_path):
    """Steps come in three runs, out of order and repeated; a query stopped between them goes on; gaps end by the timer."""
    schema = "k long, at int, kind string, ts timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(k, i, kind, f"2024-01-01 00:{i:02d}:00") for k, v in EPISODES.items() for i, kind in enumerate(v)]
    rows += [(100, 0, "call", "2024-01-01 00:00:00"), (100, 2, "submit", "2024-01-01 00:02:00")]  # its second step never comes
    rnd.shuffle(rows)
    end = [(-1, 0, "submit", "2024-02-01 00:00:00")]
    # what follows so much later meets state that is gone, and begins an episode of its own
    for part in (rows[::2], rows[1::2] + rows[:5], end, [(-2, 0, "call", "2024-02-01 00:00:01")]):
        df = spark.createDataFrame(part, "k long, at int, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = outcome_stream(spark.readStream.schema(schema).parquet(source), "k", "at", "kind", "ts", 6, stall="2 hours")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", out).trigger(availableNow=True).start().awaitTermination(200)
    rows = spark.read.parquet(out).where("k >= 0").collect()
    assert len(rows) == len({r.k for r in rows})
    assert {r.k: (r.steps, r.malformed, r.status) for r in rows} == {k: fold(v, 6) for k, v in EPISODES.items()} | {100: (2, 0, "submitted")}


def ledger(spark, path, **_):
    return Ledger(spark, f"file://{path}", "id long, ok boolean, note string", "id")


def rows(spark, *values):
    return spark.createDataFrame([(i, ok, n) for i, ok, n in values], "id long, ok boolean, note string")


def held(table):
    return {r.id: (r.ok, r.note) for r in table.collect()}


def test_ledger_of_one_writer(spark, tmp_path):
    one = ledger(spark, tmp_path)
    assert one.latest().collect() == [] and one.entries() == []
    assert one.append(rows(spark, (1, True, "a"), (2, False, "b"), (2, False, "b"))) == 1
    assert one.append(rows(spark, (1, False, "x"), (3, None, "c"))) == 2
    assert one.append(rows(spark, (1, False, "x"))) == 0 and len(one.entries()) == 2
    assert held(one.latest()) == {1: (True, "a"), 2: (False, "b"), 3: (None, "c")}
    # a rejected one is opened again, a settled one is not
    assert one.append(rows(spark, (1, False, "y"), (2, True, "second")), again=~F.col("ok")) == 3
    assert held(one.latest())[2] == (True, "second") and held(one.latest())[1] == (True, "a") and one.history().count() == 4
    assert one.append(rows(spark, (None, True, "null key"))) == 4 and one.append(rows(spark, (None, True, "again"))) == 0
    before = held(one.latest())
    assert one.compact() == 5 and held(one.latest()) == before and one.compact() == 0 and one.history().count() == 5
    assert one.vacuum(0) == 4 and held(one.latest()) == before
    candidates = spark.createDataFrame([(1,), (2,), (3,), (9,)], "id long")
    rejected = one.latest().where("id is not null").withColumn("ok", F.col("id") != 2)
    assert {r.id for r in pending(candidates, rejected, "id", "ok").collect()} == {9}
    assert {r.id for r in pending(candidates, rejected, "id", "ok", retry=True).collect()} == {2, 9}


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """The other writer enters while this one has written its rows: they share a key, and each key stands once."""
    one, two = ledger(spark, tmp_path), ledger(spark, tmp_path)
    enter, entered = Ledger._enter, []

    def late(self, entry):
        if self is one and not entered:
            entered.append(two.append(rows(spark, (1, True, "two"), (2, True, "two"))))
        enter(self, entry)

    monkeypatch.setattr(Ledger, "_enter", late)
    assert one.append(rows(spark, (2, True, "one"), (3, True, "one"))) == 2 and entered == [1]
    assert held(one.latest()) == {1: (True, "two"), 2: (True, "two"), 3: (True, "one")} and one.history().count() == 3
    entered.clear()
    monkeypatch.setattr(Ledger, "_enter", lambda self, entry: late(self, entry) if entry["remove"] else enter(self, entry))
    two_rows = rows(spark, (4, True, "two"))
    monkeypatch.setattr(two, "append", lambda _, f=two.append: f(two_rows))
    assert one.compact() == 4 and entered == [3]
    assert {k: v[1] for k, v in held(one.latest()).items()} == {1: "two", 2: "two", 3: "one", 4: "two"}
    # of two rewrites of the same folders one goes through
    entered.clear()

    def rewritten(self, entry):
        if self is one and not entered:
            entered.append(two.compact())
        enter(self, entry)

    monkeypatch.setattr(Ledger, "_enter", rewritten)
    assert one.compact() == 0 and entered == [5] and one.history().count() == 4


def test_a_number_is_taken_once(spark, tmp_path):
    one = ledger(spark, tmp_path)
    one._enter({"number": 1, "add": [], "remove": [], "batch": None})
    with pytest.raises(Conflict):
        one._enter({"number": 1, "add": ["x"], "remove": [], "batch": None})
    assert one.entries() == [{"number": 1, "add": [], "remove": [], "batch": None}] and os.listdir(tmp_path / "log") == ["000000000001.json"]


def test_a_crash_before_the_entry_leaves_nothing(spark, tmp_path, monkeypatch):
    one = ledger(spark, tmp_path)
    one.append(rows(spark, (1, True, "a")))

    def crash(self, entry):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(Ledger, "_enter", crash)
        with pytest.raises(OSError):
            one.append(rows(spark, (2, True, "b")))
    assert held(one.latest()) == {1: (True, "a")} and len(os.listdir(tmp_path / "data")) == 2
    assert one.append(rows(spark, (2, True, "b"))) == 2 and one.vacuum(3600) == 0 and one.vacuum(0) == 1
    assert held(one.latest()) == {1: (True, "a"), 2: (True, "b")}


def test_a_batch_of_a_stream_is_entered_once(spark, tmp_path):
    one = ledger(spark, tmp_path / "ledger")
    source = str(tmp_path / "in")
    for part in ([(1, True, "a"), (1, True, "a")], [(1, False, "b"), (2, True, "c")]):
        rows(spark, *part).coalesce(1).write.mode("append").parquet(source)
        one.write_stream(spark.readStream.schema("id long, ok boolean, note string").parquet(source), str(tmp_path / "state"), "verdicts").awaitTermination(100)
    assert held(one.latest()) == {1: (True, "a"), 2: (True, "c")} and [e["batch"] for e in one.entries()] == ["verdicts/0", "verdicts/1"]
    assert one.append(rows(spark, (7, True, "x")), batch="verdicts/1") == 0 and 7 not in held(one.latest())


def test_unsafe_stores_are_refused(spark, tmp_path, monkeypatch):
    class Fs:
        def getUri(self):
            return self

        def getScheme(self):
            return "s3a"

    class Path:
        def getFileSystem(self, _):
            return Fs()

    one = Ledger.__new__(Ledger)
    spark_like = type("S", (), {"sparkContext": type("C", (), {"_jvm": None, "_jsc": None})})
    monkeypatch.setattr(spark_like.sparkContext, "_jsc", type("J", (), {"hadoopConfiguration": staticmethod(lambda: None)}))
    org = type("O", (), {"apache": type("A", (), {"hadoop": type("H", (), {"fs": type("F", (), {"Path": staticmethod(lambda p: Path())})})})})
    monkeypatch.setattr(spark_like.sparkContext, "_jvm", type("V", (), {"org": org}))
    with pytest.raises(ValueError, match="s3a"):
        one.__init__(spark_like, "s3a://b/x", "id long", "id")


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows, sep="\n", last=True):
    path.write_bytes((sep.join(rows) + (sep if rows and last else "")).encode())


def test_lines_of_files_in_many_splits(small_splits, tmp_path):
    texts = {f"{n}.jsonl": [rnd.choice(["", " \t", json.dumps({"x": i, "y": "é" * rnd.randrange(30)}, ensure_ascii=False)]) for i in range(rnd.choice([0, 61, 200]))] for n in "dbca"}
    texts["d.jsonl"] = ["last"] * 40
    for i, (name, rows) in enumerate(texts.items()):
        write(tmp_path / name, rows, "\r\n" if i == 1 else "\n", i != 0)
    df = lines.lines(small_splits, str(tmp_path))
    assert small_splits.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    every = [(name, i, v) for name in sorted(texts) for i, v in enumerate(texts[name], 1)]
    assert sorted((os.path.basename(r.file), r.line_no, r.value) for r in df.collect()) == sorted(every)
    assert sorted((r.position, r.value) for r in df.collect()) == [(i, v) for i, (_, _, v) in enumerate(every)]
    full = [v for _, _, v in every if v.strip()]
    assert sorted((r.position, r.value) for r in lines.lines(small_splits, str(tmp_path), skip_blank=True).collect()) == list(enumerate(full))
    assert [r.line_no for r in jsonl.read_numbered(small_splits, str(tmp_path / "d.jsonl"), "x long").collect()] != []


def test_errors_name_the_line(small_splits, tmp_path):
    good = [json.dumps({"id": i, "v": "x" * 50}) for i in range(1, 60)]
    write(tmp_path / "good.jsonl", [*good[:20], "", *good[20:]])
    got = lines.records(small_splits, str(tmp_path / "good.jsonl"), "id long, v string", ["id", "v"])
    assert sorted((r.line_no, r.id) for r in got.collect()) == [(i + (i > 20), i) for i in range(1, 60)]
    write(tmp_path / "bad.jsonl", [*good, "{no json", *good])
    with pytest.raises(Exception, match=r"invalid JSON at .*bad.jsonl:60"):
        lines.records(small_splits, str(tmp_path / "bad.jsonl"), "id long, v string").collect()
    write(tmp_path / "empty.jsonl", [*good, "", json.dumps({"id": 1, "v": ""})])
    with pytest.raises(Exception, match=r"missing v at .*empty.jsonl:61"):
        lines.records(small_splits, str(tmp_path / "empty.jsonl"), "id long, v string", ["v"]).collect()


@pytest.mark.parametrize("n,m", [(70, 70), (70, 41), (3, 90), (0, 5)])
def test_files_joined_by_place(small_splits, tmp_path, n, m):
    write(tmp_path / "results.jsonl", [json.dumps({"task": i}) for i in range(n)])
    write(tmp_path / "traj.jsonl", [x for i in range(m) for x in ("null" if i % 7 == 3 else json.dumps({"n": i, "pad": "y" * 60}), "")])
    joined, counts = lines.zipped(small_splits, str(tmp_path / "results.jsonl"), str(tmp_path / "traj.jsonl"), "task long", "n long")
    k = min(n, m)
    assert sorted((r.position, r.left.task, r.right.n if r.right else None) for r in joined.collect()) == [(i, i, None if i % 7 == 3 else i) for i in range(k)]
    assert tuple(counts.first()) == (n, m, abs(n - m))


def test_behaviour_of_an_arm(spark, tmp_path):
    call = lambda name, arguments: {"name": name, "arguments": arguments}
    same = [call("read_file", '{"path": "a", "start_line": 1, "end_line": 2}'), call("read_file", '{"end_line":2,"start_line":1,"path":"a"}'), call("read_file", '{ "start_line": 1, "path": "a", "end_line": 2}')]
    trajectories = [{"tool_calls": same}, None, {"tool_calls": []}, {"tool_calls": [call("edit_file", "{}"), call("run_tests", "{}")] * 2 + [call("submit", "{}")]}, {"tool_calls": [call("read_file", "no json"), call("submit", "{}")]}]
    write(tmp_path / "r.jsonl", [json.dumps({"task_id": i}) for i in range(6)])
    write(tmp_path / "t.jsonl", [json.dumps(t) for t in trajectories])
    joined, counts = lines.zipped(spark, str(tmp_path / "r.jsonl"), str(tmp_path / "t.jsonl"), "task_id long", "tool_calls array<struct<name: string, arguments: string>>")
    row = episodes.arm_behaviour(joined, counts).first().asDict()
    assert row == {
        "episodes": 3, "calls": 10, "submits": 2, "never_submit": 1, "ranged_reads": 3, "whole_reads": 1, "repeated": 1, "long": 1, "stuck": 1, "n_left": 6, "n_right": 5, "n_cut": 1,
    }


def test_evaluation_summary(spark):
    schema = "task string, status string, steps int, resolved boolean, patch_valid boolean"
    df = spark.createDataFrame([("a", "submitted", 4, True, True), ("b", "submitted", 8, False, True), ("c", "budget_exhausted", 30, False, False), ("d", "submitted", 2, False, False)], schema)
    row = episodes.evaluation_summary(df).first()
    assert (row.n, row.resolved, row.rate, row.submitted, row.valid_rate, row.mean_steps) == (4, 1, 0.25, 3, 0.5, 4.666667)
    none = episodes.evaluation_summary(df.limit(0)).first()
    assert (none.n, none.resolved, none.rate, none.low, none.high, none.valid_rate, none.mean_steps) == (0, 0, 0.0, 0.0, 1.0, 0.0, None)
    nulls = episodes.evaluation_summary(spark.createDataFrame([("a", "submitted", None, None, None)], schema)).first()
    assert (nulls.n, nulls.resolved, nulls.valid_rate, nulls.mean_steps) == (1, 0, 0.0, None)


def test_sizes_count_arguments(spark):
    df = spark.createDataFrame([(1, "abc", ["{}", None]), (1, None, None), (2, "x", ["12345"])], "k long, text string, arguments array<string>")
    assert {r.k: r.size for r in transcripts.sizes(df, "k", F.col("text"), F.col("arguments")).collect()} == {1: 5, 2: 6}
    kind = "array<struct<role: string, content: string, tool_calls: array<struct<function: struct<name: string, arguments: string>>>>>"
    df = spark.createDataFrame([(1, [("user", "abc", None), ("assistant", None, [(("f", "12345"),), (("g", None),)])])], f"k long, messages {kind}")
    assert [tuple(r) for r in df.select(labels.usable("messages", 8, with_calls=True), labels.usable("messages", 7, with_calls=True), labels.usable("messages", 3)).collect()] == [(True, False, True)]
