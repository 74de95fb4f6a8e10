"""Search by trigrams, in histories, and augmentation, against scans of lines and of checked-out trees."""

import hashlib
import random
import re

import pytest

from skein.operators import augment, history, search, trigrams
from skein.stored import stored

rnd = random.Random(17)
LETTERS = ["a", "b", "ab", "é", " ", "x", "foo", "bar\r"]


def lines_of(text):
    lines = text.split("\n")
    return lines[:-1] if lines[-1] == "" else lines


@pytest.mark.parametrize(
    "expression,alternatives",
    [
        ("hello", [["ell", "hel", "llo"]]), ("(foo|bar)baz", [["arb", "bar", "baz", "rba"], ["baz", "foo", "oba", "oob"]]), ("ab[cd]ef", [["abc", "bce", "cef"], ["abd", "bde", "def"]]),
        ("colou?r", [["col", "lor", "olo"], ["col", "lou", "olo", "our"]]), (r"^def\s+(\w+)\(", [["def"]]), ("foo.*bar", [["bar", "foo"]]), ("(?:ab){2}", [["aba", "bab"]]),
        ("(abc)+d", [["abc", "bcd"]]), ("a.c", [[]]), ("(?i)hello", [[]]), ("x*", [[]]), ("he", [[]]), (r"a(?=bcd)", [[]]),
    ],
)
def test_required_trigrams(expression, alternatives):
    shown = [sorted(bytes([t >> 16, t >> 8 & 255, t & 255]).decode() for t in a) for a in trigrams.required(expression, True)]
    assert sorted(shown) == sorted(alternatives)


def expression(depth=0):
    kind = rnd.randrange(8 if depth < 3 else 3)
    if kind < 3:
        return "".join(rnd.choices("abc", k=rnd.randrange(1, 4)))
    inner = expression(depth + 1)
    return [f"({inner}|{expression(depth + 1)})", f"(?:{inner}){rnd.choice(['*', '+', '?', '{2}', '{1,3}', '+?'])}", "[ab]", ".", inner + "[^a]"][kind - 3]


def test_every_match_has_what_is_required():
    for _ in range(1500):
        e = "".join(expression() for _ in range(rnd.randrange(1, 4)))
        need, compiled = trigrams.required(e, True), re.compile(e)
        for _ in range(20):
            text = "".join(rnd.choices("abc", k=rnd.randrange(14)))
            have = set(trigrams.of_bytes(text.encode()).tolist())
            assert not compiled.search(text) or any(a <= have for a in need), (e, text)


def test_no_expression_raises():
    with pytest.raises(ValueError, match="invalid regex"):
        trigrams.required("a(", True)


def test_lines_that_match(spark):
    texts = {i: "\n".join("".join(rnd.choices(LETTERS, k=rnd.randrange(6))) for _ in range(rnd.randrange(5))) for i in range(60)} | {100: "", 101: "\n\n", 102: None}
    asked = [("foo", False), ("ab a", False), ("a", False), (".", False), ("fo+", True), ("^a", True), ("(foo|ab)x", True), ("^$", True), ("é.?b", True), ("foo", False), (None, False), ("", True)]
    files = spark.createDataFrame(list(texts.items()), "id long, text string")
    queries = spark.createDataFrame(asked, "query string, regex boolean")
    want = set()
    for q, r in asked:
        for i, text in texts.items():
            for n, line in enumerate(lines_of(text or "") if q else [], 1):
                if re.search(q if r else re.escape(q), line):
                    want.add((q, r, i, n, line))
    got = [tuple(x) for x in trigrams.matching_lines(files, queries, ["id"], "text", is_regex="regex").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    whole = {tuple(x)[:3] for x in trigrams.matching(files, queries.where("not regex"), ["id"], "text").collect()}
    assert whole == {(q, False, i) for q, r in asked for i, t in texts.items() if q and not r and q in (t or "")}
    assert trigrams.matching_lines(files.limit(0), queries, ["id"], "text", is_regex="regex").collect() == []
    assert trigrams.matching_lines(files, queries.limit(0), ["id"], "text", is_regex="regex").collect() == []


def test_blob_id_is_git_s(spark):
    df = spark.createDataFrame([("",), ("what is up, doc?",), ("é\n",)], "text string")
    want = [hashlib.sha1(b"blob %d\0" % len(t.encode()) + t.encode()).hexdigest() for t in ("", "what is up, doc?", "é\n")]
    assert [r[0] for r in df.select(history.blob_id(df["text"])).collect()] == want
    assert want[1] == "bd9dbf5aae1a3862dd1526723246b20206e5fc37"


CHANGES = [
    ("r", "a/b.py", 1, "def foo():\n    return bar\n"), ("r", "a.py", 1, "foo = 1\nbar\n"), ("r", "a/b.py", 3, None), ("r", "a.py", 4, "bar = 2\nfoo  \n"), ("r", "dist/x.py", 1, "foo\n"),
    ("r", "bin", 1, "foo\0"), ("r", "big.txt", 1, "foo\n" + "x" * 1_000_000), ("r", "copy.py", 2, "foo = 1\nbar\n"), ("s", "a.py", 1, "foo elsewhere\n"), ("r", "a/b.py", 6, "foo again"),
]
SCHEMA = "repo string, path string, seq long, text string"


def tree(repo, seq):
    out = {}
    for r, path, s, text in sorted(CHANGES, key=lambda c: c[2]):
        if r == repo and s <= seq:
            out[path] = text
    return {p: t for p, t in out.items() if t is not None}


def searched(files, query, limit=25):
    shown, first = [], {}
    for path in sorted(files, key=lambda p: p.split("/")):
        if any(f in history.SKIP_FOLDERS for f in path.split("/")[:-1]) or "\0" in files[path][:8192] or len(files[path].encode()) > 1_000_000:
            continue
        for n, line in enumerate(lines_of(files[path]), 1):
            if query in line and len(shown) < limit:
                shown.append(f"{path}:{n}: {line.rstrip()[:400]}")
                first.setdefault(path, n)
    text = "\n".join(shown) + ("\n... results truncated" if len(shown) >= limit else "") if shown else f"no matches for {query!r}"
    return text, first, len(shown), len(shown) >= limit


def test_search_at_commits_equals_a_scan_of_the_tree(spark):
    asked = [(f"{repo}{seq}{q}", repo, seq, q) for repo in "rs" for seq in (0, 1, 2, 3, 4, 6, 9) for q in ("foo", "bar", "o", "it's", "none such")]
    requests = spark.createDataFrame(asked, "req string, repo string, seq long, query string")
    h = history.History(spark.createDataFrame(CHANGES, SCHEMA), stored)
    assert h.blobs.count() == len({t for *_, t in CHANGES if t and "\0" not in t})
    got = {r["req"]: (r["text"], {f["path"]: f["first_line"] for f in r["files"]}, r["n_lines"], r["truncated"]) for r in h.search(requests, limit=3).collect()}
    assert got == {req: searched(tree(repo, seq), q, 3) for req, repo, seq, q in asked}
    count = {r["req"]: r["n_hits"] for r in h.count(requests).collect()}
    assert count == {req: sum(q in line for t in tree(repo, seq).values() if "\0" not in t for line in lines_of(t)) for req, repo, seq, q in asked}


def test_files_of_a_patch_are_searched_as_patched(spark):
    diff = "--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,2 @@\n-foo = 1\n+fooled\n bar\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+foo new\n"
    requests = spark.createDataFrame([("at1", "r", 1, "foo", diff), ("at4", "r", 4, "foo", diff), ("none", "r", 1, "foo", None)], "req string, repo string, seq long, query string, diff string")
    h = history.History(spark.createDataFrame(CHANGES, SCHEMA), stored)
    got = {r["req"]: r["text"] for r in h.search(requests, patched=h.patched(requests)).collect()}
    patched = tree("r", 1) | {"a.py": "fooled\nbar\n", "new.py": "foo new\n"}
    # at commit 4 the diff does not apply to a.py, which stays
    assert got == {"at1": searched(patched, "foo")[0], "at4": searched(tree("r", 4) | {"new.py": "foo new\n"}, "foo")[0], "none": searched(tree("r", 1), "foo")[0]}


def test_regex_requests(spark):
    requests = spark.createDataFrame([(1, "r", 1, "^foo .*1$", True), (2, "r", 1, "^foo .*1$", False)], "req long, repo string, seq long, query string, re boolean")
    h = history.History(spark.createDataFrame(CHANGES, SCHEMA), stored)
    assert {r["req"]: r["text"] for r in h.search(requests, "re").collect()} == {1: "a.py:1: foo = 1", 2: "no matches for '^foo .*1$'"}


def pair(name, arguments, content):
    return [("assistant", None, [(None, None, (name, arguments))], None, None, None), ("tool", content, None, "x", name, False)]


def record(task, issue, steps, seq=1, diff=""):
    head = [("system", "You fix it.", None, None, None, None), ("user", issue, None, None, None, None)]
    return (task, "r", seq, issue, diff, head + [m for s in steps for m in pair(*s)], "old")


RECORD = f"task_id string, repo string, seq long, issue string, diff string, messages array<{augment.MESSAGE}>, meta string"
FILES = [("r", "pkg/core.py", 1, "class Widget_core:\n" + "    widget_size = 1\n" * 9), ("r", "pkg/other.py", 1, "x\nwidget_size\n"), ("r", "pkg/third.py", 1, "third_name\n")]
READ_CORE, READ_THIRD = ("read_file", '{"path": "pkg/core.py"}', "1: class"), ("read_file", '{"path": "pkg/third.py"}', "1: third")
EDIT = ("edit_file", '{"path": "pkg/core.py", "diff": "--- a/x\\n+++ b/x\\n@@ -1 +1 @@\\n-a\\n+b\\n+c\\n"}', "edited")


def told(row):
    """(name, arguments, note, observation) of each call, and that calls and answers alternate under the same ids."""
    body = row["messages"][2:]
    out = []
    for i, (a, b) in enumerate(zip(body[::2], body[1::2])):
        call = a["tool_calls"][0]
        assert (a["role"], b["role"], call["id"], b["tool_call_id"], b["name"], b["is_error"], call["type"]) == ("assistant", "tool", f"call_{i}", f"call_{i}", call["function"]["name"], False, "function")
        out.append((call["function"]["name"], call["function"]["arguments"], a["content"], b["content"]))
    assert row["meta"]["steps"] == len(out)
    return out


def augmented(spark, records, **options):
    h = history.History(spark.createDataFrame(FILES, SCHEMA), stored)
    return {r["task_id"]: r for r in augment.augment(spark.createDataFrame(records, RECORD), h, **options).collect()}


def test_augmented_record(spark):
    steps = [READ_CORE, READ_THIRD, READ_CORE, EDIT, ("run_tests", "{}", "status=pass\r\nwarnings=none\r\nok {x}"), ("other", "{}", "?"), ("submit", "{}", "done")]
    issue = "`widget_size` of `Widget_core` is wrong, and third_name too"
    from pyspark.sql import functions as F

    one = augmented(spark, [record("t", issue, steps)], two_step=F.lit(False))["t"]
    assert one["status"] == "ok" and one["meta"]["augmented"] == "v2" and one["meta"]["reasoning"]
    assert one["meta"]["search_queries"] == ["Widget_core", "third_name"]
    said = told(one)
    assert said == [
        ("search_repo", '{"query":"Widget_core"}', "The issue mentions `Widget_core`. I'll search the repo to find where it is defined or used.", "pkg/core.py:1: class Widget_core:"),
        ("read_file", '{"path": "pkg/core.py"}', "The search matched `pkg/core.py` (line 1). Reading the file to understand the code around the match.", "1: class"),
        ("search_repo", '{"query":"third_name"}', "The previous search matched 1 lines in 1 files, which is too broad. Narrowing down with `third_name`.", "pkg/third.py:1: third_name"),
        ("read_file", '{"path": "pkg/third.py"}', "The search matched `pkg/third.py` (line 1). Reading the file to understand the code around the match.", "1: third"),
        ("read_file", '{"path": "pkg/core.py"}', "The search matched `pkg/core.py`. Reading the file to understand the code around the match.", "1: class"),
        ("edit_file", EDIT[1], "Making a minimal change to `pkg/core.py` (+2/-1 lines) to address the issue.", "edited"),
        ("run_tests", "{}", "Running the task's tests to verify the change.", "status=pass\nok {x}"),
        ("other", "{}", None, "?"),
        ("submit", "{}", "The tests pass, so I'm submitting the patch.", "done"),
    ]
    two = augmented(spark, [record("t", issue, steps[:1])], two_step=F.lit(True), reasoning=False)["t"]
    assert two["meta"]["search_queries"] == ["widget_size", "Widget_core"]
    # the broad search shows the file, so the narrow one is planned but never needed
    assert [(n, note) for n, _, note, _ in told(two)] == [("search_repo", None), ("read_file", None)]


def test_records_without_a_search(spark):
    records = [
        record("no_read", "`widget_size`", [EDIT]), record("no_query", "nothing here", [READ_CORE]), record("second", "third_name", [READ_CORE, READ_THIRD]),
        record("early", "`widget_size`", [READ_CORE], seq=0), record("leak", "`Widget_core` SecretUser", [READ_CORE]), record("empty", "", []), record("none", None, [READ_CORE]),
    ]
    got = augmented(spark, records, leaks=("secretuser",))
    want = {"no_read": "no_read_step", "no_query": "no_discoverable_query", "second": "no_discoverable_query", "early": "no_discoverable_query", "leak": "host_path_leak", "empty": "no_read_step", "none": "no_discoverable_query"}
    assert {k: r["status"] for k, r in got.items()} == want
    assert all(r["messages"] is None and r["meta"] is None for r in got.values())
    kept = augmented(spark, [record("no_query", "nothing", [("read_file", '{"path": "pkg/core.py"}', "a\r\nb")])], keep_unaugmented=True)["no_query"]
    assert kept["meta"]["augmented"] == "cleaned-only" and [m["content"] for m in kept["messages"]] == ["You fix it.", "nothing", None, "a\nb"]
    assert augmented(spark, [record("x", "", [])][:0]) == {}


def test_patch_of_the_task_is_laid_over(spark):
    diff = "--- a/pkg/core.py\n+++ b/pkg/core.py\n@@ -1,2 +1,2 @@\n-class Widget_core:\n+class Renamed:\n     widget_size = 1\n"
    got = augmented(spark, [record("t", "`Widget_core`", [READ_CORE], diff=diff)])["t"]
    assert got["status"] == "no_discoverable_query"  # the commit has a hit, the patched file has none


def test_loose_literal_queries(spark):
    lines = spark.createDataFrame([(1, 1, "a, b"), (1, 2, "nothing"), (2, 1, "the end")], "f long, line_no long, line string")
    queries = spark.createDataFrame([(", ",), ("the",), ("the end",)], "query string")
    assert {tuple(r)[:3] for r in search.search(lines, queries, ["f"]).collect()} == {(", ", 1, 1), ("the", 2, 1), ("the end", 2, 1)}
    assert "BroadcastNestedLoopJoin" not in search.search(lines, queries, ["f"])._jdf.queryExecution().executedPlan().toString()


class Kept:
    """A keep that stores tables and remembers them by name."""

    def __init__(self):
        self.tables = {}

    def __call__(self, df, name):
        self.tables[name] = stored(df, name)
        return self.tables[name]


def test_a_history_keeps_no_rows_of_trigrams(spark):
    n = 150
    changes = [("r", f"{i % 3}.py", i, f"word{i} " + " ".join("".join(rnd.choices("abcdefgh", k=7)) for _ in range(60)) + "\nshared line\n") for i in range(n)]
    requests = [(i, "r", i, q) for i, q in enumerate(["shared", "ha"] * (n // 2))] + [(n + i, "r", n + 5, f"word{i}") for i in range(100)]
    keep = Kept()
    h = history.History(spark.createDataFrame(changes, SCHEMA), keep)
    asked = spark.createDataFrame(requests, "req long, repo string, seq long, query string")
    got = {r["req"]: r["n_hits"] for r in h.count(asked).collect()}
    state = lambda seq: {p: t for _, p, s, t in changes if s <= seq}.values()
    assert got == {req: sum(q in line for t in state(seq) for line in lines_of(t)) for req, _, seq, q in requests}
    assert sum(df.count() for df in keep.tables.values()) <= 4 * (len(changes) + len(requests))
    assert all("text" not in df.columns for df in keep.tables.values())


def test_places_of_commits_in_a_large_repository(spark, monkeypatch):
    monkeypatch.setattr(history, "PART", 3)
    commits = {("r", s) for s in [-(2**62), 2**62, 2**62 + 1, *rnd.sample(range(10**6), 60), *range(5, 30)]} | {("s", 7)}
    got = {(r["repo"], r["seq"]): r["place"] for r in history._places(spark.createDataFrame(list(commits), "repo string, seq long")).collect()}
    assert got == {(repo, s): i for repo in "rs" for i, s in enumerate(sorted(s for r, s in commits if r == repo), 1)}
    one = [c for c in commits if abs(c[1]) < 2**60]
    rows = history._places(spark.createDataFrame(one, "repo string, seq long"))
    assert {(r["repo"], r["seq"]): r["place"] for r in rows.collect()} == {(repo, s): i for repo in "rs" for i, s in enumerate(sorted(s for r, s in one if r == repo), 1)}


def test_plans_keep_shown_lines_and_no_texts_but_of_searches_that_are_used(spark):
    files = [("r", "a.py", 1, "wide_name" + "x" * 5000 + "\n"), ("r", "b.py", 1, "other_name " + "y" * 300 + "\n" * 2)]
    tasks = spark.createDataFrame([("t", "r", 1, "`wide_name` and `other_name`", "")], "task_id string, repo string, seq long, issue string, diff string")
    reads = spark.createDataFrame([("t", "a.py", 0)], "task_id string, path string, at int")
    keep = Kept()
    from pyspark.sql import functions as F

    plan = augment.plan_searches(tasks, reads, history.History(spark.createDataFrame(files, SCHEMA), keep), F.lit(False)).collect()
    assert [(r["k"], r["query"], r["text"]) for r in plan] == [(1, "wide_name", "a.py:1: " + ("wide_name" + "x" * 5000)[:400])]
    longest = lambda df: max(len(str(list(r))) for r in df.collect())
    assert longest(keep.tables["hits"]) < 600 and longest(keep.tables["found"]) < 200


def test_augmentation_keeps_texts_of_chosen_searches_alone(spark):
    keep = Kept()
    h = history.History(spark.createDataFrame(FILES, SCHEMA), keep)
    rows = augment.augment(spark.createDataFrame([record("t", "`Widget_core` and third_name", [READ_CORE])], RECORD), h).collect()
    assert [(r["status"], r["meta"]["search_queries"]) for r in rows] == [("ok", ["Widget_core"])]
    assert {name for name, df in keep.tables.items() if "text" in df.columns} == {"searches"} and keep.tables["searches"].count() == 1
    assert "trigram" not in {c for df in keep.tables.values() for c in df.columns}


def test_augmented_transcripts_make_records_of_the_texts_once(spark):
    from pyspark.sql import functions as F

    from skein.plans import searching

    n, read = 40, spark.sparkContext.accumulator(0)

    def passed(text):
        read.add(1)
        return text

    rows = [(i, "r", "en", f"shared{i % 3} wide words stand here\n" + "word " * i + f"more{i % 7} text of some length, long enough") for i in range(n)]
    documents = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").withColumn("text", F.udf(passed, "string")("text"))
    got = searching.augmented_transcripts(lambda name: documents).collect()
    assert {r["doc_id"] for r in got} == set(range(n)) and {r["status"] for r in got} == {"ok"}
    assert read.value <= 4 * n  # changes, texts of hits, those of searches, records


def test_a_step_takes_several_searches_and_calls_are_numbered_over_both(spark):
    found = lambda k, query, *files: ("t", k, query, 9, len(files), [{"path": p, "first_line": n} for p, n in files], f"text {k}")
    searches = spark.createDataFrame(
        [found(1, "one", ("a", 3)), found(2, "two", ("b", 5), ("a", 7)), found(3, "three", ("c", 1))], "task_id string, k int, query string, n_lines int, n_files int, files array<struct<path: string, first_line: long>>, text string"
    )
    steps = spark.createDataFrame([(t, i, "read_file", f'{{"path": "{p}"}}', f"seen {p}") for t in ("t", "u") for i, p in enumerate("bazb")], "task_id string, step int, name string, arguments string, content string")
    rows = sorted(tuple(r) for r in augment.merged_steps(steps, searches).collect())
    assert [(t, c, n, content) for t, c, n, _, content, _ in rows] == [
        ("t", 0, "search_repo", "text 1"), ("t", 1, "search_repo", "text 2"), ("t", 2, "read_file", "seen b"), ("t", 3, "read_file", "seen a"),
        ("t", 4, "search_repo", "text 3"), ("t", 5, "read_file", "seen z"), ("t", 6, "read_file", "seen b"), *[("u", i, "read_file", f"seen {p}") for i, p in enumerate("bazb")],
    ]
    where = [x[5].split("`")[2][:9] for x in rows if x[0] == "t" and x[2] == "read_file"]
    assert where == [" (line 5)", " (line 7)", ". Reading", ". Reading"]


def test_a_search_that_serves_two_reads_is_planned_twice_and_no_more(spark):
    files = [("r", "a.py", 1, "wide_name\n"), ("r", "b.py", 1, "x\nwide_name\n")]
    steps = [("read_file", f'{{"path": "{p}.py"}}', p) for p in "ab"]
    h = history.History(spark.createDataFrame(files, SCHEMA), stored)
    row = augment.augment(spark.createDataFrame([record("t", "`wide_name`", steps)], RECORD), h).collect()[0]
    assert row["meta"]["search_queries"] == ["wide_name", "wide_name"]
    # the first shows both files, so the second is not needed
    assert [(n, content) for n, _, _, content in told(row)] == [("search_repo", "a.py:1: wide_name\nb.py:2: wide_name"), ("read_file", "a"), ("read_file", "b")]
