"""Calls, guards, labels, compaction, verification, sources and streams on small cases with known answers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import guards, patch, text, toolcalls
from skein.operators import compaction, episodes, labels, runs, search, tasks, verify
from skein.sources import jsonl
from skein.streaming import ledger


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,name,args,reasoning",
    [
        ('I look.<|tool_call>call:read_file{path:<|"|>a "b".py<|"|>,start_line:3}<tool_call|>', "read_file", {"path": 'a "b".py', "start_line": 3}, "I look."),
        ("call: submit", "submit", {}, ""),
        ("<|tool_call>call:x{a:[1,2.5,true,null,{b:c d}],\"k\":\"q\\n\"}", "x", {"a": [1, 2.5, True, None, {"b": "c d"}], "k": "q\n"}, ""),
        ("<|channel>secret<channel|>so<bos><|tool_call>call:f{a:{}}<tool_call|>", "f", {"a": {}}, "so"),
        ("call:bad{a:<|\"|>x call:good{b:1}", "good", {"b": 1}, "call:bad{a:<|\"|>x"),
        ("call:one{a:1} call:two{b:2}", "one", {"a": 1}, ""),
    ],
)
def test_native_calls(spark, raw, name, args, reasoning):
    got = one(spark, toolcalls.parse_call(F.lit(raw)))
    assert (got.name, json.loads(got.arguments), got.reasoning, got.form, got.error) == (name, args, reasoning, "native", None)


def test_json_calls_and_garbage(spark):
    assert toolcalls.any_call('ok ```json\n{"name": "a", "params": {"z": 1, "b": [true]}}\n``` {"tool": "c", "arguments": {}}')[:2] == ("a", '{"b": [true], "z": 1}')
    assert toolcalls.any_call('x {broken {"function": {"name": "g", "arguments": "{\\"p\\": 2}"}}')[:4] == ("g", '{"p": 2}', "x {broken ", "json")
    assert toolcalls.any_call('{"name": "n", "arguments": "no json"} {"name": "m", "arguments": {}}')[0] == "m"
    for bad in ("nothing", None, "", "{}", '{"name": "x"}', "[1, 2]"):
        assert toolcalls.any_call(bad)[0] is None and toolcalls.any_call(bad)[4]
    df = spark.createDataFrame([("call:a{b:1}",), ("none",), (None,)], "t string").select(toolcalls.parse_call("t").alias("c")).select("c.*")
    assert [(r.name, r.form) for r in df.collect()] == [("a", "native"), (None, None), (None, None)]


def test_rendering_is_read_back():
    rnd = random.Random(4)

    def value(depth):
        kind = rnd.randrange(7 if depth else 5)
        return [rnd.randrange(-9, 99), rnd.random() * 10, rnd.choice([True, False, None]), rnd.choice(["", "a,b}", 'q"\n', "12", "true"]), "é" * rnd.randrange(3), [value(depth - 1) for _ in range(rnd.randrange(3))] if depth else 0, {f"k{i}": value(depth - 1) for i in range(rnd.randrange(3))} if depth else 0][kind]

    for _ in range(300):
        args = {f"a{i}": value(2) for i in range(rnd.randrange(4))}
        assert toolcalls.native_call("r " + toolcalls.render_call("tool", args)) == ("tool", args, "r ")


def test_schema_errors():
    check = lambda a: toolcalls.schema_error(a, {"p": "string", "n": "integer", "b": "boolean"}, ("p",))
    assert check({"p": "x", "n": True, "b": 3}) is None
    assert check([1]) == "arguments must be a JSON object" and check({"p": None}) == "missing required argument(s): p"
    assert check({"p": 1, "z": 2}) == "argument 'p' must be a string" and check({"p": "x", "z": 2, "y": 1}) == "unknown argument(s): z, y"


def test_guards(spark):
    report = '<testsuites><testsuite tests="1" failures="0" errors="0" skipped="%d"/></testsuites>'
    rows = [("ok", report % 0, True), ("skip", report % 1, False), ("none", "<testsuite tests='0'/>", False), ("two", '<testsuite tests="2" failures="1"/>', False), ("null", None, False), ("bad", "<broken", False)]
    df = spark.createDataFrame(rows, "k string, x string, want boolean").withColumn("c", guards.junit_counts("x"))
    assert all(r.ok == r.want for r in df.select("want", guards.junit_outcome(F.col("x"), F.col("c"))["ok"].alias("ok")).collect())
    said = {"Ran 3 tests in 1s\n\nOK": True, "Ran 0 tests in 1s\n\nOK": False, "Ran 3 tests in 1s\n\nOK (skipped=3)": False, "just printed OK": False}
    for out, want in said.items():
        assert one(spark, guards.unittest_outcome(F.lit(out))["ok"]) is want
    kill = lambda rc, s, m=None: one(spark, guards.infra_kill(F.lit(rc).cast("int"), F.lit(s), F.lit(m).cast("string")))
    assert kill(-9, "fail") and kill(None, "timeout") and not kill(1, "fail") and kill(1, "fail", "was killed by signal 9") and not kill(0, "pass", "killed by signal")
    protected = "tests/test_x.py pkg/tests/helpers.py conftest.py pytest.ini tox.ini tests/runtests.py django/test/runner.py evil.pth pkg/test_thing.py pkg/thing_test.py a\\tests\\x.py ./conftest.py test_data.json".split()
    for path in protected:
        assert one(spark, text.protected_path(F.lit(path))), path
    for path in "pkg/__init__.py django/test/utils.py src/_pytest/python.py sympy/core/basic.py attest.py".split():
        assert not one(spark, text.protected_path(F.lit(path))), path
    part = lambda p: f"--- a/{p}\n+++ b/{p}\n@@ -1 +1 @@\n-a\n+b\n"
    df = spark.createDataFrame([(part("pkg/__init__.py") + part("tests/test_add.py") + part("conftest.py"),), ("",), (None,)], "d string").withColumn("f", guards.section_table("d"))
    got = df.select(guards.sanitised(F.col("f"), F.array().cast("array<string>")).alias("s")).select("s.*").collect()
    assert got[0].patch == part("pkg/__init__.py") and got[0].dropped == ["tests/test_add.py", "conftest.py"] and got[1].patch == "" == got[2].patch
    assert one(spark, guards.allowed(F.array(F.lit("C:\\x\\Python.EXE")), ["python"])) and not one(spark, guards.allowed(F.array().cast("array<string>"), ["python"]))
    assert guards.merged({"a": 1}, {"a": 2, "b": 3}) == {"a": 2}
    with pytest.raises(ValueError):
        guards.at_least(spark.range(3), 4)
    assert one(spark, guards.hours_left(2.0, F.lit(3600.0))) == 1.0 and one(spark, guards.hours_left(None, F.lit(1.0))) is None


def test_lists_and_texts(spark):
    rows = [(None, []), ("", []), (" ", []), ("plain", ["plain"]), ('"x"', ["x"]), ("5", ["5"]), ("true", ["True"]), ('["a", 1, null]', ["a", "1", "None"]), ("[broken", ["[broken"])]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string").select(text.as_list("t").alias("l"))
    assert [r.l for r in df.collect()] == [r[1] for r in rows]
    assert one(spark, text.truncate_body(F.lit("x" * 4000))) == "x" * 4000
    assert one(spark, text.truncate_body(F.lit("h\n\n" + "a" * 3001))) == "h\n\n" + "a" * 1500 + "\n... output truncated ...\n" + "a" * 1500
    noise = "a\rwarnings=1\nC:\\\\Users\\\\me\\\\x y D:\\Users\\me\\Desktop\\p\\r\\repo\\m\\n.py me\nwarnings=2"
    assert one(spark, text.clean_observation(F.lit(noise), "/w", r"Desktop\\p", "me")) == "a\n/home/user/x y /w/m/n.py user"


def test_patches(spark):
    with pytest.raises(ValueError):
        patch.hunks("@@ -1,1 +1,3 @@\n-a\n-b\n+c\n+d\n+e")  # overshoots its source count
    assert patch.apply("a\r\nb\r\n", "@@ -1 +1 @@\r\n-a\r\n+c\r\n") == "c\nb\n"
    assert one(spark, patch.targets(F.lit("--- a/x\n+++ b/x\n+++ /dev/null\n+++ a/y z.py \t2024\r\n--- b/old\n++++ no\n+++ b/x"))) == ["x", "/dev/null", "y z.py", "old"]


def test_gate(spark):
    gate = lambda xs, **k: one(spark, episodes.gate(F.array(*[F.lit(float(x)) for x in xs]).cast("array<double>"), **k))
    assert tuple(gate([1, 3, 2, 3, 3])) == (3.0, 1, True) and tuple(gate([1, 1.05, 1.15], min_delta=0.1)) == (1.15, 2, False)
    assert gate([], patience=1).stop is False or gate([], patience=1).best_index == -1
    assert gate([3, 1, 1, 1], patience=0).stop is False


def say(role, content, **k):
    return {"role": role, "content": content, "train": None} | k


def test_labels(spark):
    df = spark.createDataFrame([([-100, -100, 7, -100, 9, 10],), ([9, -100, -100],), ([],)], "l array<int>").select(labels.sliced(F.col("l")).alias("s"))
    assert [(r.s.keep, r.s.targets) for r in df.collect()] == [([1, 3, 4], [7, 9, 10]), ([], []), ([], [])]
    rows = [([("user", "hi", None), ("assistant", "a", None), ("assistant", "b", False)],), ([("user", "x", None)],)]
    got = spark.createDataFrame(rows, f"m {labels.MESSAGES}").select(labels.encoded(F.col("m")).alias("e")).collect()
    ids = [ord(c) % 30000 + 2 for c in "<user>hi</user><assistant>a</assistant><assistant>b</assistant>"]
    assert got[0].e.input_ids == ids and [i for i, x in enumerate(got[0].e.labels) if x != -100] == list(range(15, 39))
    assert [x for x in got[1].e.labels if x != -100] == [got[1].e.input_ids[-1]]


def test_fitting():
    turns = [m for i in range(8) for m in (say("assistant", f"step{i}"), say("tool", "o" * 30))]
    messages = [say("system", "SYSTEM"), say("user", "ISSUE"), *turns, say("assistant", "FINAL")]
    out, dropped, shrunk, hard = labels.fitted(messages, 420)
    kept = [m["content"] for m in out]
    assert kept[:2] == ["SYSTEM", "ISSUE"] and kept[-1] == "FINAL" and "step7" in kept and "step0" not in kept and dropped > 0 and hard == 0
    assert labels.length(out) <= 420 and shrunk == 0
    long = [say("user", "ISSUE"), say("tool", "x" * 9000), say("assistant", "end")]
    out, dropped, shrunk, hard = labels.fitted(long, 3000)
    assert shrunk == 2 and hard == 0 and "chars truncated" in out[1]["content"] and labels.fitted(long, 99999)[0] == long
    assert labels.fitted([say("assistant", "y" * 500)], 100)[3] == 1
    ids, mask = labels.step_sample(messages[:4], list(range(50)), 200)
    assert len(ids) <= 200 and mask[-50:] == list(range(50)) and set(mask[:-50]) == {-100}
    assert labels.step_sample(messages[:4], list(range(900)), 200)[0][-100:] == list(range(100))


def call(name, **arguments):
    return {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "function": {"name": name, "arguments": json.dumps(arguments)}}]}


def trajectory():
    lines = "\n".join(f"{n:>3}: line {n}" for n in range(1, 301))
    diff = "--- a/m.py\n+++ b/m.py\n@@ -150,3 +150,3 @@\n line 150\n-line 151\n+new\n line 152"
    return [say("system", "s"), say("user", "u"), call("read_file", path="m.py"), say("tool", lines), call("edit_file", path="m.py", diff=diff), say("tool", "ok"), call("submit", note="x"), say("tool", "done")]


MESSAGES = "array<struct<role: string, content: string, tool_calls: array<struct<id: string, function: struct<name: string, arguments: string>>>, is_error: boolean>>"


def compacted(spark, *messages, **options):
    df = spark.createDataFrame([(i, json.dumps(m), (3,)) for i, m in enumerate(messages)], "k long, m string, meta struct<steps: int>")
    df = df.select("k", F.from_json("m", MESSAGES).alias("messages"), "meta")
    return compaction.compact(df, "k", **options).orderBy("k").collect()


def asked(message):
    return message["tool_calls"][0]["function"]["name"], json.loads(message["tool_calls"][0]["function"]["arguments"])


def listing(*numbers):
    return "\n".join(f"{n}: line {n}" for n in numbers)


def test_compaction(spark):
    (row,) = compacted(spark, trajectory())
    out = row.messages
    assert asked(out[2]) == ("read_file", {"path": "m.py", "start_line": 110, "end_line": 192}) and row.meta.asDict() == {"steps": 3, "compacted": True, "recovery_example": False}
    seen = out[3]["content"].split("\n")
    assert seen[0] == "110: line 110" and seen[-1] == "192: line 192" and len(seen) == 83 and asked(out[6]) == ("submit", {})
    assert [m.content for m in out[:2]] == ["s", "u"] and asked(out[4]) == ("edit_file", json.loads(trajectory()[4]["tool_calls"][0]["function"]["arguments"]))
    (row,) = compacted(spark, trajectory(), recovery_rate=1.0)
    out = row.messages
    bad = [m for m in out if m.train is False]
    assert row.meta.recovery_example and len(bad) == 1 and " line 150  # stale\n" in asked(bad[0])[1]["diff"] and bad[0].tool_calls[0].id == "call_bad"
    errors = [m for m in out if m.role == "tool" and m.content.startswith("error:")]
    assert len(errors) == 1 and errors[0].is_error and errors[0].tool_call_id == "call_bad" and errors[0].name == "edit_file"
    assert [asked(m)[0] for m in out if m.tool_calls] == ["read_file", "edit_file", "edit_file", "submit"] and out[6].content == out[6].content and asked(out[6]) == asked(compacted(spark, trajectory())[0].messages[4])
    rows = compacted(spark, *[trajectory()] * 40, recovery_rate=0.5)
    assert 5 < sum(r.meta.recovery_example for r in rows) < 35


def test_what_compaction_leaves(spark):
    edit = trajectory()[4]
    far = call("edit_file", path="m.py", diff="@@ -900,2 +900 @@\n-a")
    cases = {
        "unrelated": [call("read_file", path="o.py"), say("tool", listing(*range(1, 200))), edit, say("tool", "ok")],
        "short": [call("read_file", path="o.py"), say("tool", listing(1, 2, 3))],
        "gap": [call("read_file", path="o.py"), say("tool", listing(*range(1, 50), *range(60, 200)))],
        "failed": [call("read_file", path="o.py"), say("tool", listing(*range(1, 200))) | {"is_error": True}],
        "no answer": [call("read_file", path="o.py"), say("user", listing(*range(1, 200))), call("submit", note="x")],
        "beyond": [call("read_file", path="m.py"), say("tool", listing(*range(1, 200))), far, say("tool", "ok")],
        "twice": [call("read_file", path="o.py"), say("tool", listing(*range(1, 130)) + "\n7: other\nno number")],
        "searches": [call("search_repo", query="q"), say("tool", "\n".join(map(str, range(30))) + "\n... results truncated"), call("search_repo", query="q"), say("tool", "a\nb")],
        "tests": [call("run_tests"), say("tool", "head\n\n" + "x" * 2000 + "y" * 2000), call("run_tests"), say("tool", "x" * 4000)],
        "wide": [call("read_file", path="m.py"), say("tool", listing(*range(1, 700))), call("edit_file", path="m.py", diff="@@ -100 +1 @@\n@@ -600,5 +1 @@"), say("tool", "ok")],
        "none": [say("user", "u"), say("assistant", None)],
        "empty": [],
    }
    got = dict(zip(cases, compacted(spark, *cases.values(), recovery_rate=1.0)))
    assert [k for k, r in got.items() if r.meta.recovery_example] == ["beyond"]
    text = {k: [m.content for m in r.messages] for k, r in got.items()}
    assert asked(got["unrelated"].messages[0])[1] == {"path": "o.py", "start_line": 1, "end_line": 120} and text["unrelated"][1].split("\n")[0] == "  1: line 1"
    for k in ("short", "gap", "failed", "no answer", "none", "empty"):
        assert text[k] == [m["content"] for m in cases[k]], k
    assert asked(got["no answer"].messages[2]) == ("submit", {"note": "x"})
    assert asked(got["beyond"].messages[0])[1] == {"path": "m.py", "start_line": 860, "end_line": 199} and text["beyond"][1] == ""
    assert text["twice"][1].split("\n")[6] == "  7: other" and len(text["twice"][1].split("\n")) == 120
    assert text["searches"][1].split("\n") == [*map(str, range(25)), "... results truncated"] and text["searches"][3] == "a\nb"
    assert text["tests"][1] == "head\n\n" + "x" * 1500 + "\n... output truncated ...\n" + "y" * 1500 and text["tests"][3] == "x" * 4000
    assert asked(got["wide"].messages[0])[1] == {"path": "m.py", "start_line": 60, "end_line": 459}


def test_spoilt_diffs(spark):
    assert one(spark, compaction.stale(F.lit("--- a\n+++ b\n@@ @@\n x\n-y"))) == "--- a\n+++ b\n@@ @@\n x  # stale\n-y" and one(spark, compaction.stale(F.lit("+a\n "))) is None


def test_reading_lines(spark):
    read = lambda t, a=None, b=None: one(spark, compaction.read_lines(F.lit(t), F.lit(a).cast("int"), F.lit(b).cast("int"), F.lit("p")))
    assert read("a\nb\n") == "1: a\n2: b" and read("a\nb\nc", 2) == "2: b\n3: c" and read("a", 3, 9) == "error: no lines in range 3-9 for p"
    assert read("a", 0, 1).startswith("error: start_line") and read("a", 2, 1).startswith("error: end_line") and read("") == "error: end_line must be >= start_line"
    many = "\n".join("x" * 1 for _ in range(500))
    assert read(many).endswith("\n... showing lines 1-250 of 500; pass start_line/end_line to read more") and read(many, 1, 500).endswith("400: x\n... truncated at 400 lines")


def test_verification(spark):
    strings = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    specs = one(spark, verify.test_specs(F.lit("django"), strings("test_foo (tests.bar.Baz)", "unparseable"), strings(), strings("tests/bar/tests.py")))
    assert specs[0].targets == ["tests.bar.Baz.test_foo"] and len(specs) == 2 and "bar.tests" in specs[1].targets
    specs = one(spark, verify.test_specs(F.lit("pytest-k"), strings("test_solve", "test_limit"), strings(), strings("a.py")))
    assert specs[0].k_expr == "test_limit or test_solve" and specs[0].targets == ["a.py"] and specs[1].k_expr == ""
    specs = one(spark, verify.test_specs(F.lit("pytest"), strings("tests/test_x.py::test_y"), strings("tests/test_a.py::test_b"), strings()))
    assert specs[0].targets == ["tests/test_x.py::test_y", "tests/test_a.py::test_b"] and len(specs) == 1

    def judge(pre, post, rc=0, status="pass", f2p=("a.py::x",), broken=False):
        return one(spark, verify.verdict(F.lit("pytest"), strings(*f2p), strings(*f2p, "a.py::z"), F.lit(pre), F.lit(post), F.lit(status), F.lit(rc), F.lit(broken)))

    assert judge("FAILED a.py::x", "a.py::x PASSED").verified
    assert judge("FAILED a.py::q", "a.py::x PASSED").reason.startswith("fail-to-pass tests already pass")
    assert judge("FAILED a.py::x", "a.py::x PASSED\na.py::z FAILED", 1).reason == "tests broken by the gold patch: a.py::z"
    drift = judge("FAILED a.py::x\nFAILED a.py::z", "a.py::x PASSED\na.py::z FAILED", 1)
    assert drift.verified and drift.env_drift == ["a.py::z"]
    assert "missing or failed" in judge("FAILED a.py::x", "", 1).reason and "rc=2" in judge("FAILED a.py::x", "z", 2).reason
    assert judge("", "", 0).verified and judge("", "tail\n", 1, "fail").reason == "post-patch tests did not pass (fail, rc=1): tail "
    assert judge("", "a.py::x PASSED", broken=True).verified
    assert one(spark, verify.budgeted(strings("aaa", "b", "c"), 6)) == ["aaa", "b"]


def test_search_meets_on_words(spark):
    files = spark.createDataFrame([(1, "a foo bar b\nfoobar"), (2, "x\nfoo bar"), (3, None)], "id long, text string")
    asked = spark.createDataFrame([("a foo b",), ("foo bar",), ("o",), ("(",)], "query string")
    got = sorted((r.query, r.id, r.line_no) for r in search.search(search.lines_of(files, ["id"], "text"), asked, ["id"]).collect())
    assert got == [("a foo b", 1, 1), ("foo bar", 1, 1), ("foo bar", 2, 2), ("o", 1, 1), ("o", 1, 2), ("o", 2, 2)]
    names = spark.createDataFrame([(1, "see `plain` and my_func.call in getValue, error this_is")], "id long, t string")
    got = [(r.token, r.score) for r in search.candidates(names, "id", "t").orderBy("rank").collect()]
    assert got[:2] == [("plain", 2), ("my_func.call", 2)] and {"my_func", "getValue", "this_is"} <= {t for t, _ in got} and "error" not in dict(got)


def test_dev_slice_and_pool(spark):
    df = spark.range(5).selectExpr("id")
    dev, train = tasks.dev_slice(df, F.col("id"), 9)
    assert dev.count() == 4 and train.count() == 1 and tasks.dev_slice(df, F.col("id"), 0)[0].count() == 0
    assert tasks.public_pool(spark.range(1).selectExpr("id task_id", "1 gold_patch", "2 other_gold", "3 repo")).columns == ["task_id", "repo"]
    with pytest.raises(Exception, match="no record of 9"):
        episodes.arm(df, spark.createDataFrame([(1,), (9,)], "id long"), "id").collect()


def test_sources(spark, tmp_path):
    path = str(tmp_path / "t")
    assert jsonl.write_jsonl(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), path) == 2
    assert jsonl.append_unseen(spark.createDataFrame([(2, "b"), (3, "c"), (3, "d")], "id int, v string"), path, "id") == 1
    assert jsonl.append_unseen(spark.createDataFrame([(2, "b")], "id int, v string"), path, "id") == 0
    assert jsonl.read_strict(spark, path, "id int, v string").count() == 3
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(tmp_path / "none"), "id int").count()
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.jsonl").write_text('{"id": 1, "v": "a"}\n\n {"id": 2}\n')
    assert [(r.line_no, r.id) for r in jsonl.read_numbered(spark, str(tmp_path / "f"), "id int, v string").orderBy("line_no").collect()] == [(1, 1), (3, 2)]
    with pytest.raises(Exception, match="missing v at .*x.jsonl:3"):
        jsonl.read_tasks(spark, str(tmp_path / "f"), "id int, v string", ["v"]).collect()
    (tmp_path / "f" / "sub").mkdir()
    (tmp_path / "f" / "sub" / "y.txt").write_text("z")
    assert sorted(r.path for r in jsonl.read_tree(spark, str(tmp_path / "f")).collect()) == ["sub/y.txt", "x.jsonl"]
    steps = spark.createDataFrame([("o/checkpoint-9",), ("o/checkpoint-100",), ("o/other",)], "path string")
    assert jsonl.last_checkpoint(steps).first().path == "o/checkpoint-100"
    spark.createDataFrame([("a/b", 1), ("c/d", 2), ("a/b", 3)], "repo string, n int").write.parquet(str(tmp_path / "p"))
    assert jsonl.read_instances(spark, str(tmp_path / "p"), ["a/b"], 5).count() == 2 and jsonl.read_instances(spark, str(tmp_path / "p"), None, 1).count() == 1
    jsonl.write_summary(spark.createDataFrame([(1, 0.5)], "n int, rate double"), str(tmp_path / "s"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "s")).collect()] == [{"n": 1, "rate": 0.5}]
    jsonl.write_aligned(spark.createDataFrame([(1, True, "t"), (2, False, None)], "id int, ok boolean, traj string"), "id", ["ok"], "traj", str(tmp_path / "r"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 == spark.read.json(str(tmp_path / "r")).where("ok is not null").count()


def test_gate_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "run string, i int, score double"
    for rows in ([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 2.0)], [("a", 2, 2.0), ("a", 3, 3.0), ("a", 4, 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        ledger.gate_stream(spark.readStream.schema(schema).json(src), out, cp, "run", "i", "score").awaitTermination(120)
    last = {r.run: r for r in spark.read.json(out + "/batch=1").collect()}
    assert (last["a"].best, last["a"].best_index, last["a"].stop, last["a"].n) == (3.0, 1, True, 5) and "b" not in last


def test_code_signatures(spark):
    same = [("x = 1  # a\n", "x  =  1\n\n"), ("def f():\n    return 1\n", "def f():\n  # c\n  return 1\n"), ("((", "((  \n# x")]
    assert all(runs.code_signature(a) == runs.code_signature(b) for a, b in same) and runs.code_signature("x = 1") != runs.code_signature("x = 2")
    df = spark.createDataFrame([("a.py", "x=1", "x = 1 # c"), ("a.txt", "x", "x "), ("b.py", None, "y")], "p string, a string, b string")
    assert [r.c for r in df.select(runs.changes_code("p", "a", "b").alias("c")).collect()] == [False, True, True]


def test_trees_are_patched_file_by_file(spark):
    part = lambda p, a, b: f"--- a/{p}\n+++ b/{p}\n@@ -{'0,0' if not a else 1} +1 @@\n" + (f"-{a}\n" if a else "") + f"+{b}\n"
    files = spark.createDataFrame([(1, "x", "a\nb\n"), (1, "y", "q\n")], "k long, path string, text string")
    diffs = spark.createDataFrame([(1, part("x", "a", "A") + part("y", "zzz", "Z") + part("new", "", "n"))], "k long, diff string")
    got = {r.path: (r.ok, r.text) for r in runs.apply_to_tree(files, diffs, "k").collect()}
    assert got == {"x": (True, "A\nb\n"), "y": (False, None), "new": (True, "n\n")}
    assert one(spark, runs.unnested(F.array(F.array(F.lit(1), F.lit(2))))) == [1, 2]
