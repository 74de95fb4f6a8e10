"""Transcripts that show how a file was found: searches planned from the issue, merged into the steps, notes put to them.

A record is a row with task_id, repo, seq (its commit), issue, diff (its test patch) and messages: system and user messages,
then pairs of an assistant message with one tool call and the tool's answer.  Generated steps are merged as rows: a step's
place is its number, a search's place is just before the read that needs it, one sort a record makes the order, and call ids
are the row numbers of it.

The searches before a read are all those up to the first that shows its path (all, if none does); as a search once shown stays
shown, the number of searches before step i is a running maximum over the reads before it, and no state is folded.

A record without reads, or whose first read no search finds, is dropped, or kept with cleaned answers.  Messages beyond the
last whole pair are dropped; a null text is empty.  A repeated task_id is a mistake of the table and not looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import without_token
from ..functions.hashing import byte_draw
from ..functions.text import clean_observation, diff_stats
from .history import History
from .search import BROAD_LINES, candidates

#: Hits above which a name says too little, files of a list that one can read, share of tasks with a broad search first
MAX_HITS, MAX_FILES, TWO_STEP = 400, 25, 0.25
#: The notes, and what the record's meta says
SEARCHED = "The issue mentions `%s`. I'll search the repo to find where it is defined or used."
NARROWED = "The previous search matched %d lines in %d files, which is too broad. Narrowing down with `%s`."
READ = "The search matched `%s`%s. Reading the file to understand the code around the match."
EDITED = "Making a minimal change to `%s` (+%d/-%d lines) to address the issue."
TESTED = "Running the task's tests to verify the change."
PASSED, SUBMITTED = "The tests pass, so I'm submitting the patch.", "Submitting the patch."
AUGMENTED, CLEANED = "v2", "cleaned-only"

CALL = "struct<id: string, type: string, function: struct<name: string, arguments: string>>"
MESSAGE = f"struct<role: string, content: string, tool_calls: array<{CALL}>, tool_call_id: string, name: string, is_error: boolean>"


def steps_of(records: DataFrame) -> DataFrame:
    """(task_id, step, name, arguments, content, is_error) of every pair of messages."""
    body = F.filter("messages", lambda m: m["role"].isin("assistant", "tool"))
    rows = records.select("task_id", body.alias("b")).where(F.size("b") > 1)
    pairs = rows.select("task_id", "b", F.explode(F.sequence(F.lit(0), F.floor(F.size("b") / 2).cast("int") - 1)).alias("step"))
    call, seen = F.get("b", F.col("step") * 2)["tool_calls"], F.get("b", F.col("step") * 2 + 1)
    function = F.get(call, F.lit(0))["function"]
    return pairs.select("task_id", "step", function["name"].alias("name"), function["arguments"].alias("arguments"), F.coalesce(seen["content"], F.lit("")).alias("content"))


def reads_of(steps: DataFrame) -> DataFrame:
    """(task_id, path, at): the paths that a task reads, and the first step that does."""
    path = F.get_json_object("arguments", "$.path")
    return steps.where((F.col("name") == "read_file") & (path != "")).groupBy("task_id", path.alias("path")).agg(F.min("step").alias("at"))


def plan_searches(tasks: DataFrame, reads: DataFrame, history: History, two_step: Column | None = None) -> DataFrame:
    """(task_id, k, query, n_lines, n_files, files, text): the searches of each task, in order; none for tasks that it cannot help.

    A name of the issue serves if it has hits, not too many, and its list is whole and shows a path that is read.  Each read
    path takes the search with the fewest lines, then the best name; two_step (by default a draw by task) puts one with more
    lines before the first.
    """
    two_step = byte_draw(F.col("task_id").cast("string"), TWO_STEP) if two_step is None else two_step
    names = candidates(tasks, "task_id", "issue").select("task_id", F.col("token").alias("query"), "rank")
    asked = names.join(tasks.select("task_id", "repo", "seq"), "task_id").withColumn("req", F.concat_ws("/", F.col("rank").cast("string"), F.col("task_id").cast("string")))
    asked = history.keep(asked, "asked")
    hits = history.keep(history.hits(asked), "hits")
    counted = history.counted(asked, hits).where(F.col("n_hits").between(1, MAX_HITS))
    diffs, patched = tasks.where(F.length("diff") > 0), None
    if not diffs.isEmpty():
        patched = history.patched(diffs.select(F.col("task_id").alias("req"), "repo", "seq", "diff")).withColumnRenamed("req", "task_id")
        patched = history.keep(patched.join(asked.select("task_id", "req"), "task_id").select("req", "path", "text"), "patched")
    found = history.search(counted, patched=patched, hits=hits, text=False).where(~F.col("truncated") & F.size("files").between(1, MAX_FILES))
    found = history.keep(found, "found")
    by_path = found.select("task_id", "query", "rank", "n_lines", F.explode("files.path").alias("path")).join(reads, ["task_id", "path"])
    of = Window.partitionBy("task_id", "path")
    best = by_path.withColumn("best", F.row_number().over(of.orderBy("n_lines", "rank")) == 1)
    best = best.withColumn("least", F.min("n_lines").over(of)).withColumn("at0", F.min("at").over(Window.partitionBy("task_id")))
    broad = (F.col("n_lines") >= BROAD_LINES) & (F.col("n_lines") > F.col("least")) & (F.col("at") == F.col("at0")) & two_step
    best = best.withColumn("broad", broad).withColumn("b", F.row_number().over(of.orderBy(F.desc("broad"), F.desc("n_lines"), "rank")) == 1)
    chosen = best.where("best or (broad and b)")
    first = reads.groupBy("task_id").agg(F.min("at").alias("first"))  # the first read must be among those found
    chosen = chosen.join(first, "task_id").where("at0 = first")
    k = F.row_number().over(Window.partitionBy("task_id").orderBy("at", "best"))  # a broad one stands before the narrow one
    chosen = chosen.select("task_id", "query", k.alias("k"))
    chosen = found.join(chosen, ["task_id", "query"]).select("task_id", "k", "req", "query", "n_lines", F.size("files").alias("n_files"), "files")
    chosen = history.keep(chosen, "chosen")  # only these need their texts; a search may serve two reads, and is then there twice
    said = history.search(chosen.select("req", "query").distinct(), patched=patched, hits=hits).select("req", "text")
    return chosen.join(said, "req").select("task_id", "k", "query", "n_lines", "n_files", "files", "text")


def merged_steps(steps: DataFrame, searches: DataFrame, reasoning: bool = True, **cleaning) -> DataFrame:
    """(task_id, call, name, arguments, content, note): steps and the searches that they need, in order and numbered anew.

    steps: (task_id, step, name, arguments, content); searches: plan_searches.  cleaning: see clean_observation.
    """
    order = Window.partitionBy("task_id").orderBy("step")
    path = F.when(F.col("name") == "read_file", F.get_json_object("arguments", "$.path"))
    shows = searches.select("task_id", "k", F.explode("files").alias("f")).select("task_id", "k", F.col("f.path").alias("path"), F.col("f.first_line").alias("line"))
    first = shows.groupBy("task_id", "path").agg(F.min("k").alias("shown_by"), F.collect_list(F.struct("k", "line")).alias("lines"))
    n = searches.groupBy("task_id").agg(F.count("*").cast("int").alias("n_searches"))
    rows = steps.withColumn("path", path).join(first, ["task_id", "path"], "left").join(n, "task_id", "left").withColumn("n_searches", F.coalesce("n_searches", F.lit(0)))
    need = F.when(F.col("path").isNotNull(), F.coalesce("shown_by", "n_searches"))
    rows = rows.withColumn("after", F.coalesce(F.max(need).over(order), F.lit(0)))  # searches before this step
    rows = rows.withColumn("before", F.coalesce(F.lag("after").over(order), F.lit(0)))
    rows = rows.withColumn("content", clean_observation(F.col("content"), **cleaning))
    passing = (F.col("name") == "run_tests") & F.startswith(F.col("content"), F.lit("status=pass"))
    rows = rows.withColumn("passed", F.coalesce(F.bool_or(passing).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    rows = rows.withColumn("line", F.get(F.filter("lines", lambda x: x["k"] == F.col("after")), F.lit(0))["line"])
    stats = diff_stats(F.regexp_replace(F.coalesce(F.get_json_object("arguments", "$.diff"), F.lit("")), "\r\n", "\n"))
    where = F.when(F.col("line").isNotNull(), F.format_string(" (line %d)", "line")).otherwise("")
    note = (
        F.when(F.col("name") == "read_file", F.format_string(READ, F.coalesce("path", F.lit("")), where))
        .when(F.col("name") == "edit_file", F.format_string(EDITED, F.coalesce(F.get_json_object("arguments", "$.path"), F.lit("the file")), stats["added"], stats["removed"]))
        .when(F.col("name") == "run_tests", TESTED)
        .when(F.col("name") == "submit", F.when(F.col("passed") | F.startswith(F.col("content"), F.lit("status=pass")), PASSED).otherwise(SUBMITTED))
    )
    # a search stands before the step at which the number of searches passes it; each step gives a row for those and its own, without k
    due = F.when(F.col("after") > F.col("before"), F.sequence(F.col("before") + 1, F.col("after"))).otherwise(F.array().cast("array<int>"))
    rows = rows.select("task_id", "step", "name", "arguments", "content", note.alias("note"), F.explode(F.concat(due, F.array(F.lit(None).cast("int")))).alias("k"))
    own = lambda c: F.when(F.col("k").isNull(), F.col(c)).alias(c)
    rows = rows.select("task_id", "step", "k", *[own(c) for c in ("name", "arguments", "content", "note")])
    last = Window.partitionBy("task_id").orderBy("k")
    told = searches.withColumns({"_n": F.lag("n_lines").over(last), "_f": F.lag("n_files").over(last)})
    said = F.when(F.col("_n").isNull(), F.format_string(SEARCHED, "query")).otherwise(F.format_string(NARROWED, "_n", "_f", "query"))
    told = told.select("task_id", "k", F.to_json(F.struct("query")).alias("_arguments"), F.col("text").alias("_content"), said.alias("_note"))
    either = lambda c, other: F.when(F.col("k").isNull(), F.col(c)).otherwise(other).alias(c)
    rows = rows.join(told, ["task_id", "k"], "left").select("task_id", "step", "k", either("name", F.lit("search_repo")), *[either(c, F.col(f"_{c}")) for c in ("arguments", "content", "note")])
    call = F.row_number().over(Window.partitionBy("task_id").orderBy("step", F.col("k").asc_nulls_last())) - 1
    note = F.translate("note", "{}", "()") if reasoning else F.lit(None).cast("string")
    return rows.select("task_id", call.alias("call"), "name", "arguments", "content", note.alias("note"))


def messages_of(merged: DataFrame) -> DataFrame:
    """(task_id, body, steps): the merged steps as messages, a call and its answer each."""
    call = F.format_string("call_%d", F.col("call"))
    function = F.struct(F.col("name").alias("name"), F.col("arguments").alias("arguments"))
    none = F.lit(None)
    asked = F.struct(F.lit("assistant").alias("role"), F.col("note").alias("content"), F.array(F.struct(call.alias("id"), F.lit("function").alias("type"), function.alias("function"))).alias("tool_calls"), none.cast("string").alias("tool_call_id"), none.cast("string").alias("name"), none.cast("boolean").alias("is_error"))
    seen = F.struct(F.lit("tool").alias("role"), F.col("content").alias("content"), none.cast(f"array<{CALL}>").alias("tool_calls"), call.alias("tool_call_id"), F.col("name").alias("name"), F.lit(False).alias("is_error"))
    rows = merged.select("task_id", F.struct("call", F.array(asked.cast(MESSAGE), seen.cast(MESSAGE)).alias("m")).alias("s"))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["m"]))
    return rows.groupBy("task_id").agg(ordered.alias("body"), F.count("*").cast("int").alias("steps"))


def augment(records: DataFrame, history: History, reasoning: bool = True, leaks: tuple[str, ...] = (), keep_unaugmented: bool = False, two_step: Column | None = None, **cleaning) -> DataFrame:
    """records with status (ok, no_read_step, no_discoverable_query, host_path_leak), new messages, and meta.

    Only ok rows have searches in them; of the others messages and meta are null, or with keep_unaugmented cleaned ones.
    leaks: words that no row may hold, in any case.
    """
    steps = steps_of(records)
    reads = history.keep(reads_of(steps), "reads")
    tasks = records.select("task_id", "repo", "seq", F.coalesce("issue", F.lit("")).alias("issue"), F.coalesce("diff", F.lit("")).alias("diff"))
    searches = history.keep(plan_searches(tasks, reads, history, two_step), "searches")
    queries = searches.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "query"))), lambda s: s["query"]).alias("search_queries"))
    new = messages_of(merged_steps(steps.join(queries.select("task_id"), "task_id"), searches, reasoning, **cleaning))
    head = F.transform(F.filter("messages", lambda m: m["role"].isin("system", "user")), lambda m: _message(records, m, m["content"]))
    both = records.join(new, "task_id", "left").join(queries, "task_id", "left").join(reads.select("task_id", F.lit(True).alias("_reads")).distinct(), "task_id", "left")
    cleaned = F.transform("messages", lambda m: _message(records, m, F.when(m["role"] == "tool", clean_observation(m["content"], **cleaning)).otherwise(m["content"])))
    made = both.withColumn("_new", F.when(F.col("search_queries").isNotNull(), F.concat(head, F.col("body"))))
    leak = F.lit(False)
    for word in leaks:
        leak = leak | ~without_token(F.struct("issue", "_new"), word)
    status = F.when(F.col("_reads").isNull(), "no_read_step").when(F.col("search_queries").isNull(), "no_discoverable_query").when(leak, "host_path_leak").otherwise("ok")
    made = made.withColumn("status", status)
    ok = F.col("status") == "ok"
    meta = F.struct(
        F.when(ok, F.col("steps")).alias("steps"), F.when(ok, AUGMENTED).otherwise(CLEANED).alias("augmented"),
        F.when(ok, F.col("search_queries")).alias("search_queries"), F.when(ok, F.lit(reasoning)).alias("reasoning"),
    )
    kept = ok | F.lit(keep_unaugmented)
    others = [F.col(c) for c in records.columns if c not in ("messages", "meta", "status")]
    return made.select(*others, "status", F.when(ok, F.col("_new")).when(kept, cleaned).alias("messages"), F.when(kept, meta).alias("meta"))


def _message(records: DataFrame, m: Column, content: Column) -> Column:
    """A message of the records with this content, as MESSAGE; fields that theirs lack are null."""
    fields = records.schema["messages"].dataType.elementType
    have = fields.fieldNames()
    of_call = fields["tool_calls"].dataType.elementType.fieldNames()
    call = lambda c: F.struct(*[(c[f] if f in of_call else F.lit(None)).cast(kind).alias(f) for f, kind in (("id", "string"), ("type", "string"), ("function", "struct<name: string, arguments: string>"))])
    rest = [(m[f] if f in have else F.lit(None)).cast(kind).alias(f) for f, kind in (("tool_call_id", "string"), ("name", "string"), ("is_error", "boolean"))]
    return F.struct(m["role"].cast("string").alias("role"), content.alias("content"), F.transform(m["tool_calls"], call).alias("tool_calls"), *rest).cast(MESSAGE)
