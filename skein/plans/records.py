"""More queries over the driver's tables: transcripts to labels, calls, verification, search, reports.

conversations are transcripts (assistant messages are trained on), events tool calls with their arguments in props, documents
files and issues, lineitem rollouts or tokens, labels verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards, text, toolcalls
from ..operators import compaction, episodes, labels, rollouts, runs, search, tasks, verify
from ..streaming import ledger
from .catalog import SPLIT, _wilson_sql, query

# ---------------------------------------------------------------- tool calls

ARGS = """'{"k": ' || json_extract(props, '$.k')::bigint || ', "who": "u' || user_id || '"}'"""


def _calls(t) -> DataFrame:
    e = t("events").select("event_id", "user_id", "ts", F.col("event_type").alias("name"), F.get_json_object("props", "$.k").alias("k"))
    return e.withColumn("arguments", F.format_string('{"k": %s, "who": "u%d"}', "k", "user_id"))


@query(f"select event_id, event_type as name, {ARGS} as arguments, 'so: ' || event_id as reasoning, case event_id % 3 when 0 then 'native' else 'json' end as form from events")
def parsed_calls(t):
    e = _calls(t)
    native = F.format_string('so: %d<|tool_call>call:%s{who:<|"|>u%d<|"|>, k: %s}<tool_call|>', "event_id", "name", "user_id", "k")
    fenced = F.format_string('so: %d```json\n{"tool": "%s", "arguments": %s}\n```', "event_id", "name", "arguments")
    inner = F.concat(F.format_string('so: %d\n{"function": {"name": "%s", "arguments": ', "event_id", "name"), F.to_json(F.array("arguments")), F.lit("}}"))
    inner = F.regexp_replace(F.regexp_replace(inner, r'"arguments": \["', '"arguments": "'), r'"\]\}\}$', '"}}')
    said = F.when(F.col("event_id") % 3 == 0, native).when(F.col("event_id") % 3 == 1, fenced).otherwise(inner)
    out = e.withColumn("c", toolcalls.parse_call(said)).select("event_id", "c.name", "c.arguments", "c.reasoning", "c.form")
    return out.withColumn("reasoning", F.regexp_replace("reasoning", r"\s*```json$", ""))


@query(f"select event_id, event_type as name, {ARGS} as arguments from events")
def rendered_calls(t):
    e = _calls(t).withColumn("c", toolcalls.parse_call(toolcalls.render("name", "arguments")))
    return e.select("event_id", "c.name", "c.arguments")


@query(f"select user_id, event_type || ' ' || {ARGS} as signature, count(*) as n from events group by 1, 2")
def call_signatures(t):
    e = _calls(t).withColumn("swapped", F.format_string('{"who":"u%d",   "k":%s}', "user_id", "k"))
    return e.select("user_id", F.concat_ws(" ", "name", toolcalls.canonical("swapped")).alias("signature")).groupBy("user_id", "signature").agg(F.count("*").alias("n"))


@query(
    """select event_id, case when event_id % 4 = 0 then 'missing required argument(s): who' when event_id % 4 = 1 then 'argument ''k'' must be a string'
when event_id % 4 = 2 then 'unknown argument(s): z' end as error from events"""
)
def argument_checks(t):
    i = F.col("event_id") % 4
    given = F.when(i == 0, '{"k": "a", "who": null}').when(i == 1, '{"who": "b", "k": 1, "z": 2}').when(i == 2, '{"who": "b", "z": 2}').otherwise('{"who": "b", "n": true}')
    return t("events").select("event_id", toolcalls.check_arguments(given, {"k": "string", "who": "string", "n": "integer"}, ("who",)).alias("error"))


@query(
    """with c as (select user_id, ts, event_id, event_type as name, json_extract(props, '$.k')::bigint as k, event_type || json_extract(props, '$.k') as sig from events),
r as (select *, case when lag(sig) over w = sig then 0 else 1 end as new from c window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(new) over (partition by user_id order by ts, event_id) as run from r),
l as (select user_id, max(n) as longest from (select user_id, run, count(*) as n from i group by 1, 2) group by 1),
p as (select user_id, count(*) as n, count(distinct sig) as kinds, count_if(name = 'purchase') as submits, count_if(name = 'view') as reads, count_if(name = 'view' and k > 0) as ranged from c group by 1)
select count(*) as episodes, sum(n)::bigint as calls, sum(submits)::bigint as submits, count_if(submits = 0)::bigint as never_submit, sum(ranged)::bigint as ranged_reads,
(sum(reads) - sum(ranged))::bigint as whole_reads, count_if(longest >= 3)::bigint as repeated, count_if(n >= 4)::bigint as long, count_if(n >= 4 and kinds <= 3)::bigint as stuck from p join l using (user_id)"""
)
def behaviour_report(t):
    name = F.when(F.col("event_type") == "purchase", "submit").when(F.col("event_type") == "view", "read_file").otherwise(F.col("event_type"))
    k = F.get_json_object("props", "$.k")
    calls = t("events").select("user_id", "ts", "event_id", name.alias("name"), F.format_string('{"start_line":%s,"end_line":%s}', k, k).alias("arguments"))
    return episodes.behaviour(calls, ["user_id"], ["ts", "event_id"], "name", "arguments")


# ---------------------------------------------------------------- guards and predicates


@query(
    """select event_id, event_type = 'login' or (event_id % 30) in (6, 9, 11, 24, 25) or (event_type = 'error' and event_id % 2 = 0) as infra from events"""
)
def infra_kills(t):
    status = F.when(F.col("event_type") == "login", "timeout").when(F.col("event_type") == "error", "fail").otherwise("pass")
    message = F.when(F.col("event_id") % 2 == 0, "killed by signal 9").otherwise(F.lit(None).cast("string"))
    return t("events").select("event_id", guards.infra_kill(-(F.col("event_id") % 30), status, message).alias("infra"))


ERRORS = "case event_id % 5 when 0 then 'Environment setup failed: x' when 1 then 'torch.OutOfMemoryError' when 2 then 'CUDA out of memory' when 3 then 'boom environment' end"


@query(f"select case when lower(e) like '%environment setup failed%' then 'environment' when lower(e) like '%outofmemory%' or lower(e) like '%out of memory%' then 'oom' else 'scored' end as kind, count(*) as n from (select {ERRORS} as e from events) group by 1")
def episode_kinds(t):
    return t("events").groupBy(guards.episode_kind(F.expr(ERRORS)).alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"""select category, count(*) as n from (select case when event_type = 'purchase' then 'resolved' when event_type = 'error' and event_id % 5 = 0 then 'test_environment_issue'
when event_type = 'error' and event_id % 5 in (1, 2) then 'infrastructure_error' when event_type = 'error' then 'policy_error' when event_type = 'login' then 'step_budget_exhaustion'
when event_type = 'view' then 'incomplete_patch' when event_id % 2 = 0 then 'test_environment_issue' else 'wrong_file' end as category, {ERRORS} from events) group by 1
union all select category, 0 from (values ('resolved'), ('wrong_file'), ('incomplete_patch'), ('test_environment_issue'), ('infrastructure_error'), ('step_budget_exhaustion'), ('policy_error')) c(category)
where category not in (select case event_type when 'purchase' then 'resolved' when 'login' then 'step_budget_exhaustion' when 'view' then 'incomplete_patch' when 'error' then 'policy_error' else 'wrong_file' end from events
  union all select case when event_type = 'error' then 'infrastructure_error' else 'test_environment_issue' end from events)"""
)
def failure_categories(t):
    e = F.col("event_type")
    status = F.when(e == "error", "error").when(e == "login", "budget_exhausted").otherwise("submitted")
    tests = F.when(F.col("event_id") % 2 == 0, "timeout").otherwise("fail")
    kind = episodes.failure_category(e == "purchase", F.expr(ERRORS), status, e != "view", tests)
    return episodes.category_counts(t("events"), kind)


@query(
    """select page_id, url like 'http://%' or url like 'https://%' as remote, not ('x' || url like '%/../%' or url like '/%') as confined from pages"""
)
def path_predicates(t):
    return t("pages").select("page_id", guards.remote(F.col("url")).alias("remote"), guards.confined(F.concat(F.lit("x"), "url")).alias("confined"))


@query(
    """select p_partkey, 'a__b' || case when p_partkey % 3 = 0 and p_size / 10.0 >= 4 then '-new' when p_partkey % 3 = 0 and p_size / 10.0 >= 2.5 then '-mid' else '' end as venv from part"""
)
def venv_slugs(t):
    repo = F.when(F.col("p_partkey") % 3 == 0, "a/b").otherwise("/a/b.git")
    version = F.concat((F.col("p_size") / 10).cast("decimal(9,1)").cast("string"), F.lit("rc1"))
    return t("part").select("p_partkey", guards.venv_slug(repo, version, {"a/b": {2.5: "mid", 4.0: "new"}}).alias("venv"))


PROTECTED = "case page_id % 8 when 0 then 'pkg/test_data.json' when 1 then 'src\\tests\\a.py' when 2 then './conftest.py' when 3 then 'src/core.py' when 4 then 'a//thing_test.py' when 5 then 'x.pth' when 6 then 'attests/b.py' else '' end"


@query(f"select page_id, page_id % 8 not in (3, 6) as protected from pages")
def protected_paths(t):
    return t("pages").select("page_id", text.protected_path(F.expr(PROTECTED.replace("\\", "\\\\"))).alias("protected"))


@query("select doc_id, source from documents where not contains(lower(text), 'the') and not contains(lower(source), 'the')")
def leak_guard(t):
    return t("documents").where(guards.without_token(F.struct("text", "source"), "THE")).select("doc_id", "source")


@query(
    """select event_id, event_id % 7 > 0 and event_id % 5 = 0 as ok, case when event_id % 7 = 0 then 'no tests were executed' when event_id % 5 = 1 then 'runner did not report OK'
when event_id % 5 = 0 then 'tests passed' else 'target tests were skipped' end as reason from events"""
)
def unittest_outcomes(t):
    i = F.col("event_id")
    said = F.when(i % 5 == 0, "OK").when(i % 5 == 1, "FAILED (failures=1)").otherwise("OK (skipped=2)")
    out = F.format_string("x\nRan %d tests in 0.1s\n\n%s\n", i % 7, said)
    return t("events").select("event_id", guards.unittest_outcome(out).alias("o")).select("event_id", "o.ok", "o.reason")


SUITES = "case when l_linenumber = 7 then null else l_linenumber + 2 end"


@query(
    f"""with j as (select l_orderkey, l_linenumber, l_linenumber + 2 as tests, (l_quantity::bigint % 2) as failures, (l_suppkey % 2) as skipped from lineitem),
o as (select *, case when l_linenumber = 7 then 'junit report unreadable' when l_linenumber = 6 then 'no junit report produced' when skipped > 0 then skipped || ' target test(s) skipped'
  when failures > 0 then 'junit reports failures' else 'tests passed' end as reason from j)
select l_orderkey, l_linenumber, reason = 'tests passed' as resolved, case when reason = 'tests passed' then 'pass' else 'fail' end as test_status, false as infra_error, reason from o"""
)
def scored_submissions(t):
    two = '<testsuites><testsuite tests="2" failures="0"><testsuite tests="%d" failures="%d" errors="0" skipped="%d"/></testsuite></testsuites>'
    xml = F.format_string(two, "l_linenumber", F.col("l_quantity").cast("long") % 2, F.col("l_suppkey") % 2)
    xml = F.when(F.col("l_linenumber") == 7, "<broken").when(F.col("l_linenumber") == 6, F.lit(None).cast("string")).otherwise(xml)
    rows = t("lineitem").select("l_orderkey", "l_linenumber", xml.alias("xml")).withColumn("counts", guards.junit_counts("xml"))
    done = guards.score(F.lit("pass"), F.lit(0), F.lit(""), guards.junit_outcome(F.col("xml"), F.col("counts")))
    return rows.select("l_orderkey", "l_linenumber", done.alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query(
    """select page_id, case when page_id % 2 = 0 then '' else chr(10) end || 'kept' || page_id as patch, 1 as dropped from (select page_id from pages) where false union all
select page_id, '--- a/src/p' || page_id || '.py' || chr(10) || '+++ b/src/p' || page_id || '.py' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-a' || chr(10) || '+b' || chr(10) as patch, 2 as dropped from pages"""
)
def sanitised_patches(t):
    section = lambda path: F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1 +1 @@\n-a\n+b\n"))
    own = F.format_string("src/p%d.py", "page_id")
    diff = F.concat(section(F.lit("conftest.py")), section(own), section(F.lit("./extra/file.py")), F.lit("--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n"))
    rows = t("pages").select("page_id", guards.section_table(diff).alias("found"))
    clean = guards.sanitised(F.col("found"), F.array(F.lit("extra/file.py")))
    return rows.select("page_id", clean.alias("s")).select("page_id", "s.patch", F.size("s.dropped").alias("dropped"))


# ---------------------------------------------------------------- transcripts to labels

SAID = "('<' || role || '>' || text || '</' || role || '>')"
CODES = f"list_transform(string_split({SAID}, ''), lambda c: unicode(c) % 30000 + 2)"
LABELS = f"""(select conv_id, flatten(list(ids order by turn)) as input_ids, flatten(list(case when role = 'assistant' then ids else list_transform(ids, lambda x: -100) end order by turn)) as labels
from (select conv_id, turn, role, {CODES} as ids from conversations) group by conv_id)"""
ENCODED = f"(select conv_id, input_ids, case when len(list_filter(labels, lambda x: x <> -100)) > 0 then labels else list_concat(list_transform(input_ids[1:-2], lambda x: -100), input_ids[-1:]) end as labels from {LABELS})"


def _transcripts(t) -> DataFrame:
    message = F.struct("turn", "role", F.col("text").alias("content"), F.lit(None).cast("boolean").alias("train"))
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda m: m.dropFields("turn")).alias("messages"))


def _encoded(t) -> DataFrame:
    return _transcripts(t).withColumn("e", labels.encoded(F.col("messages"))).select("conv_id", "e.input_ids", "e.labels")


def _digest(a):
    return F.md5(F.array_join(a, ","))


@query(f"select conv_id, md5(array_to_string(input_ids, ',')) as ids, md5(array_to_string(labels, ',')) as labels, len(labels)::int as n from {ENCODED}")
def label_masks(t):
    return _encoded(t).select("conv_id", _digest("input_ids").alias("ids"), _digest("labels").alias("labels"), F.size("labels").alias("n"))


KEPT = f"(select conv_id, labels, list_filter(range(2, len(labels) + 1), lambda i: labels[i] <> -100) as spots from {ENCODED})"


@query(f"select conv_id, md5(array_to_string(list_transform(spots, lambda i: i - 2), ',')) as keep, md5(array_to_string(list_transform(spots, lambda i: labels[i]), ',')) as targets from {KEPT}")
def sliced_labels(t):
    return _encoded(t).withColumn("s", labels.sliced(F.col("labels"))).select("conv_id", _digest("s.keep").alias("keep"), _digest("s.targets").alias("targets"))


@query(
    f"""with n as (select len(list_filter(labels, lambda x: x <> -100)) as n from {ENCODED}), s as (select list(n order by n) as a from n)
select len(a) as n, a[1]::int as least, a[len(a) // 2 + 1]::int as p50, a[-1]::int as most from s"""
)
def supervised_counts(t):
    return labels.supervised_stats(_encoded(t), "labels")


@query(
    f"""with b as (select *, conv_id % 16 as batch from {ENCODED}), w as (select batch, ceil(max(len(input_ids)) / 8.0)::int * 8 as width from b group by batch)
select conv_id, width::int as width, (width - len(input_ids))::int as pad, md5(array_to_string(list_concat(labels, list_transform(range(width - len(labels)), lambda i: -100)), ',')) as labels from b join w using (batch)"""
)
def padded_batches(t):
    rows = labels.padded(_encoded(t).withColumn("batch", F.col("conv_id") % 16), "batch", 0)
    return rows.select("conv_id", F.size("input_ids").alias("width"), F.size(F.filter("attention", lambda x: x == 0)).alias("pad"), _digest("labels").alias("labels"))


@query(
    f"""with k as (select *, conv_id % 16 as batch, list_transform(spots, lambda i: i - 2) as keep from {KEPT}), u as (select batch, list(distinct p) as p from (select batch, unnest(keep) as p from k) group by batch)
select conv_id, len(p)::int as rows, len(spots)::int as own from k join u using (batch)"""
)
def batch_slices(t):
    rows = labels.batch_slices(_encoded(t).select("conv_id", "labels", (F.col("conv_id") % 16).alias("batch")), "batch")
    return rows.select("conv_id", F.size("logits_to_keep").alias("rows"), F.size(F.filter("shift_labels", lambda x: x != labels.MASKED)).alias("own"))


@query(
    """select conv_id, count(*)::int as n from conversations group by conv_id having count(*) >= 3 and sum(length(text)) <= 2500"""
)
def usable_transcripts(t):
    rows = _transcripts(t).where(labels.usable(F.col("messages"), 2500, 3))
    return rows.select("conv_id", F.size("messages").alias("n"))


@query()
def fitted_transcripts(t):
    """Transcripts fitted to 700 ids."""
    out = _transcripts(t).withColumn("f", labels.fit("messages", 700))
    return out.select("conv_id", F.size("f.messages").alias("n"), "f.dropped_turns", "f.shrunk_messages", "f.hard_truncated")


@query()
def fit_report(t):
    """Sums over fitted_transcripts."""
    f = fitted_transcripts(t)
    hard = F.sum("hard_truncated")
    return f.agg(F.sum("dropped_turns").alias("dropped"), F.count_if(F.col("shrunk_messages") > 0).alias("shrunk"), hard.alias("hard"), F.round(hard / F.count("*"), 6).alias("hard_share"))


@query("select conv_id, count(*)::int as n, least(count(*), 3)::int as picked, (count(*) - 1)::int as last from conversations group by conv_id")
def step_choice(t):
    rows = _transcripts(t).withColumn("s", labels.chosen_steps(F.size("messages"), 3, F.col("conv_id")))
    return rows.select("conv_id", F.size("messages").alias("n"), F.size(F.array_distinct("s")).alias("picked"), F.element_at("s", -1).alias("last"))


@query()
def step_samples(t):
    """A sample for each transcript's last message as a completion."""
    rows = _transcripts(t).where(F.size("messages") > 1).withColumn("ids", labels.char_ids(F.element_at("messages", -1)["content"]))
    prompt = F.slice("messages", F.lit(1), F.size("messages") - 1)
    return rows.withColumn("s", labels.step_samples(prompt, "ids", 512)).select("conv_id", F.size("s.input_ids").alias("n"), _digest("s.labels").alias("labels"))


@query(
    """with m as (select *, case when role = 'user' then 'tool' else role end as r, lag(text) over w as before, row_number() over w as k from conversations window w as (partition by conv_id order by turn)),
c as (select conv_id, coalesce(bool_or(r = 'tool' and starts_with(text, 'I')), false) as err, arg_min(contains(left(before, 32), 'a'), turn) filter (where r = 'assistant' and k > 1) as ok from m group by conv_id)
select count(*) as trajectories, count_if(err)::bigint as with_error, count_if(ok)::bigint as submit_after_pass from c"""
)
def supervision_table(t):
    said = F.when(F.col("text").startswith("I") & (F.col("role") == "user"), F.concat(F.lit("error: "), "text")).otherwise(F.regexp_replace("text", "error:", ""))
    said = F.when(F.left("text", F.lit(32)).contains("a"), F.concat(F.when(said.startswith("error: "), "error: ").otherwise(""), F.lit("status=pass"))).otherwise(F.translate(said, "=", "-"))
    role = F.when(F.col("role") == "user", "tool").otherwise(F.col("role"))
    rows = t("conversations").select("conv_id", "turn", role.alias("role"), said.alias("text"), F.when(F.col("role") == "assistant", "submit").alias("name"))
    return episodes.supervision(rows, "conv_id", "turn", "role", "name", "text")


@query("select event_type as kind, count(*) as n from events where event_type <> 'view' group by 1")
def error_kinds(t):
    rows = t("events").select(F.when(F.col("event_type") != "view", "tool").otherwise("user").alias("role"), F.concat(F.lit("error: "), "event_type", F.lit(": more")).alias("text"))
    return episodes.error_kinds(rows, "role", "text")


@query("select conv_id, turn, coalesce(bool_or(starts_with(text, 'T')) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), false) as passed_before from conversations")
def passed_before(t):
    rows = t("conversations").select("conv_id", "turn", F.when(F.col("text").startswith("T"), "status=pass").otherwise("no").alias("text"))
    return search.passed_before(rows, "conv_id", "turn", "text").select("conv_id", "turn", "passed_before")


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as call_i, greatest(1, length(text) // 4)::int as tokens from conversations")
def numbered_steps(t):
    call = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("int")
    return t("conversations").select("conv_id", "turn", call.cast("long").alias("call_i"), tokens.alias("tokens"))


# ---------------------------------------------------------------- rollouts

GATE = "max_delta"


@query(
    """with recursive s as (select user_id, value as v, row_number() over (partition by user_id order by ts, event_id) as k from events),
g as (select user_id, 0::bigint as k, '-inf'::double as best, -1 as spot from s group by user_id union all
select g.user_id, s.k, case when s.v > g.best + 5 then s.v else g.best end, case when s.v > g.best + 5 then s.k::int - 1 else g.spot end from g join s on s.user_id = g.user_id and s.k = g.k + 1)
select user_id, arg_max(best, k) as best, arg_max(spot, k) as best_index, max(k) - 1 - arg_max(spot, k) >= 20 as stop from g group by user_id"""
)
def early_stop(t):
    scores = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"])
    rows = t("events").groupBy("user_id").agg(episodes.gate(scores, 5.0, 20).alias("g"))
    return rows.select("user_id", "g.best", "g.best_index", "g.stop")


ON = "l_returnflag <> 'N'"


@query(
    f"""select l_orderkey, count_if({ON})::bigint as tokens, round(-sum(case when {ON} then l_tax * l_discount else 0 end) / greatest(count_if({ON}), 1), 6) + 0 as pg,
round(sum(case when {ON} then exp(l_tax - l_discount) - (l_tax - l_discount) - 1 else 0 end) / greatest(count_if({ON}), 1), 6) + 0 as kl from lineitem group by 1"""
)
def grpo_loss(t):
    rows = t("lineitem").select("l_orderkey", "l_discount", F.col("l_tax"), F.col("l_tax").alias("adv"), F.expr(ON).alias("on"))
    out = rollouts.loss_terms(rows, "l_orderkey", "l_discount", "l_tax", "adv", "on", 0.1)
    return out.select("l_orderkey", "tokens", F.round("pg", 6).alias("pg"), F.round("kl", 6).alias("kl"))


@query("select l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) over (partition by l_orderkey), 6) as scale from lineitem")
def token_weights(t):
    rows = rollouts.token_weights(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", F.round("scale", 6).alias("scale"))


@query(
    """with w as (select l_orderkey, l_linenumber, l_quantity as q, avg(l_quantity) over p as a, stddev_pop(l_quantity) over p as s from lineitem window p as (partition by l_orderkey))
select l_orderkey, l_linenumber, round(case when s < 1e-8 then 0 else (q - a) / s end, 6) + 0 as advantage from w"""
)
def legacy_advantages(t):
    rows = rollouts.legacy_advantage(t("lineitem"), "l_orderkey", F.col("l_quantity"))
    return rows.select("l_orderkey", "l_linenumber", F.round("advantage", 6).alias("advantage"))


@query("select user_id, count(*) as n, round(avg(value), 6) as mean_reward, max(value) as best_reward, round(count_if(event_type = 'purchase') / count(*)::double, 6) as rate from events group by 1")
def update_metrics(t):
    rows = t("events").select("user_id", "value", (F.col("event_type") == "purchase").alias("ok"))
    return ledger.update_metrics(rows, "user_id", "value", "ok")


# ---------------------------------------------------------------- verification


@query(
    """with l as (select l_orderkey, list(distinct 't.py::c' || l_linenumber order by 't.py::c' || l_linenumber) as f2p, list(distinct 't.py::c' || l_linenumber) filter (where l_returnflag <> 'R') as pass_post,
  list(distinct 't.py::c' || l_linenumber) filter (where l_returnflag = 'R') as fail_post from lineitem group by 1),
m as (select l_orderkey, list_filter(f2p, lambda x: not list_contains(coalesce(pass_post, []), x)) as missing from l)
select l_orderkey, len(missing) = 0 as verified, case when len(missing) = 0 then 'fail-to-pass verified' else 'fail-to-pass tests not proven post-patch (missing or failed): ' || array_to_string(missing, ', ') end as reason from m"""
)
def verdicts(t):
    name = F.format_string("t.py::c%d", "l_linenumber")
    rows = t("lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(name)).alias("f2p"),
        F.array_join(F.collect_list(F.concat(name, F.lit(" FAILED"))), "\n").alias("pre"),
        F.array_join(F.collect_list(F.concat(name, F.when(F.col("l_returnflag") == "R", " FAILED").otherwise(" PASSED"))), "\n").alias("post"),
    )
    v = verify.verdict(F.lit("pytest"), F.col("f2p"), F.col("f2p"), F.col("pre"), F.col("post"), F.lit("fail"), F.lit(1), F.lit(False))
    return rows.select("l_orderkey", v.alias("v")).select("l_orderkey", "v.verified", "v.reason")


FLIP = "(select l_orderkey, list(distinct l_linenumber::varchar) filter (where {}) as a from lineitem group by 1)"


@query(
    """with s as (select l_orderkey, coalesce(list(distinct l_linenumber) filter (where l_returnflag = 'A'), []) as f2p, coalesce(list(distinct l_linenumber) filter (where l_linestatus = 'F'), []) as failed_post,
  coalesce(list(distinct l_linenumber) filter (where l_tax > 0.04), []) as failed_pre, coalesce(list(distinct l_linenumber) filter (where l_linestatus = 'O'), []) as passed_post from lineitem group by 1)
select l_orderkey, len(list_filter(f2p, lambda x: not list_contains(passed_post, x)))::int as not_passing, len(list_filter(failed_post, lambda x: not list_contains(failed_pre, x)))::int as broken,
len(list_filter(failed_post, lambda x: list_contains(failed_pre, x) and not list_contains(f2p, x)))::int as drift, list_has_any(f2p, failed_pre) as flips from s"""
)
def flip_sets(t):
    some = lambda c: F.collect_set(F.when(F.expr(c), F.col("l_linenumber").cast("string")))
    rows = t("lineitem").groupBy("l_orderkey").agg(
        some("l_returnflag = 'A'").alias("f2p"), F.struct(some("l_linestatus = 'O'").alias("passed"), some("l_linestatus = 'F'").alias("failed")).alias("post"),
        F.struct(F.array().cast("array<string>").alias("passed"), some("l_tax > 0.04").alias("failed")).alias("pre"),
    )
    f = verify.flip(F.col("f2p"), F.col("pre"), F.col("post"), F.lit(False))
    return rows.select("l_orderkey", f.alias("f")).select("l_orderkey", F.size("f.not_passing").alias("not_passing"), F.size("f.broken").alias("broken"), F.size("f.env_drift").alias("drift"), "f.flips")


@query(
    """with l as (select l_orderkey, list(distinct l_linenumber order by l_linenumber) as ns from lineitem group by 1),
d as (select *, list_transform(ns, lambda n: case when n % 3 = 0 then 'app.tests.C.t' || n else 'app.sub.tests.C.t' || n end) as labels from l where not list_contains(ns, 5))
select l_orderkey, array_to_string(list_sort(labels), ' ') as exact,
array_to_string(list_sort(list_concat(['other'], list_distinct(list_transform(ns, lambda n: case when n % 3 = 0 then 'app.tests' else 'app.sub.tests' end)))), ' ') as coarse from d"""
)
def django_specs(t):
    n = F.col("l_linenumber")
    entry = F.when(n % 3 == 0, F.format_string("t%d (app.tests.C)", n)).when(n == 5, "Named tests are dropped").otherwise(F.format_string("t%d (app.sub.tests.C.t%d)", n, n))
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(entry).alias("f2p")).where(~F.array_contains("f2p", "Named tests are dropped"))
    files = F.array(F.lit("tests/other.py"))
    specs = verify.test_specs(F.lit("django"), F.col("f2p"), F.array().cast("array<string>"), files)
    rows = rows.withColumn("specs", specs)
    return rows.select("l_orderkey", F.array_join(F.get("specs", F.lit(0))["targets"], " ").alias("exact"), F.array_join(F.get("specs", F.lit(1))["targets"], " ").alias("coarse"))


@query(
    """with l as (select l_orderkey, coalesce(list_sort(list(distinct 'f' || l_linenumber) filter (where l_returnflag = 'A')), []) as f2p, list_sort(list(distinct 'f' || l_linenumber)) as p2p from lineitem group by 1)
select l_orderkey, array_to_string(list_concat(f2p, list_filter(p2p[1:3], lambda x: not list_contains(f2p, x))), ' ') as targets, array_to_string(f2p, ' or ') as k_expr from l"""
)
def node_specs(t):
    name = F.format_string("f%d", "l_linenumber")
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "A", name)).alias("f2p"), F.collect_set(name).alias("p2p"))
    none = F.array().cast("array<string>")
    nodes = verify.test_specs(F.lit("pytest"), F.col("f2p"), F.col("p2p"), none, 3)
    named = verify.test_specs(F.lit("pytest-k"), F.col("f2p"), none, none)
    return rows.select("l_orderkey", F.array_join(F.get(nodes, F.lit(0))["targets"], " ").alias("targets"), F.get(named, F.lit(0))["k_expr"].alias("k_expr"))


@query(
    """select event_id, 'status=' || event_type || chr(10) || 'duration=' || printf('%.1f', event_id::double) || 's' || chr(10) || 'returncode=1' || chr(10) || 'message=m' ||
case when event_id % 2 = 0 then chr(10) || 'warnings=a | b' else '' end || case when event_id % 3 = 0 then chr(10) || chr(10) || 'body' else '' end as note from events"""
)
def run_notes(t):
    i, none = F.col("event_id"), F.array().cast("array<string>")
    warned = F.when(i % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none)
    note = verify.run_note(F.col("event_type"), i.cast("double"), F.lit(1), F.lit("m"), warned, none, F.when(i % 3 == 0, "body").otherwise(""))
    return t("events").select("event_id", note.alias("note"))


@query(
    """select doc_id, doc_id || '__x' as venv, quality from documents join labels using (doc_id)"""
)
def pool_records(t):
    instances = t("documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("/x.git")).alias("repo"))
    evidence = t("labels").select("doc_id", "quality", F.lit("").alias("venv"))
    return tasks.merged_evidence(instances, evidence, "doc_id", "repo").select("doc_id", "venv", "quality")


@query(
    """select doc_id::varchar as instance_id, 'https://github.com/' || source || '.git' as repo_url, length(coalesce(text, ''))::int as n_issue, 2 as n_f2p, 'SWE' as source from documents"""
)
def normalised_instances(t):
    raw = t("documents").select(
        F.col("doc_id").cast("string").alias("instance_id"), F.col("source").alias("repo"), F.lit("c").alias("base_commit"), F.col("text").alias("problem_statement"),
        F.lit('["a", 1]').alias("FAIL_TO_PASS"), F.lit(None).cast("string").alias("patch"),
    )
    out = tasks.normalised(raw, "SWE").where("gold_patch = '' and size(pass_to_pass) = 0")
    return out.select("instance_id", "repo_url", F.length("issue").alias("n_issue"), F.size("fail_to_pass").alias("n_f2p"), "source")


# ---------------------------------------------------------------- search and reads

LINES = "(select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from (select doc_id, string_split(text, chr(10)) as ls from documents))"
ASKED = "(values (' the '), ('the'), ('s the a'), (', ')) q(query)"


def _queries(t) -> DataFrame:
    asked = F.explode(F.array(*[F.lit(x) for x in (" the ", "the", "s the a", ", ")]))
    return t("region").limit(1).select(asked.alias("query"))


@query(f"select query, doc_id, line_no::bigint as line_no from {LINES} l, {ASKED} where contains(line, query)")
def literal_search(t):
    found = search.search(search.lines_of(t("documents").select("doc_id", "text"), ["doc_id"], "text"), _queries(t), ["doc_id"])
    return found.select("query", "doc_id", "line_no")


@query(
    f"""with h as (select query, doc_id, line_no, row_number() over (partition by query order by doc_id, line_no) as k, count(*) over (partition by query) as n from {LINES} l, {ASKED} where contains(line, query))
select query, doc_id, min(line_no)::bigint as first_line, count(*) as n_lines, any_value(n) >= 25 as truncated from h where k <= 25 group by 1, 2"""
)
def search_page(t):
    found = search.search(search.lines_of(t("documents").select("doc_id", "text"), ["doc_id"], "text"), _queries(t), ["doc_id"])
    some = search.limited(found, ["query"], ["doc_id", "line_no"])
    return search.first_lines(some, ["query", "truncated"], "doc_id").select("query", "doc_id", "first_line", "n_lines", "truncated")


@query(
    f"""with h as (select doc_id, line_no from {LINES} where contains(line, ' the ')) select doc_id, line_no::bigint as line_no from h where doc_id % 5 <> 0
union all select doc_id, 0 from documents where doc_id % 5 = 0"""
)
def overridden_hits(t):
    lines = search.lines_of(t("documents").select("doc_id", "text"), ["doc_id"], "text").where(F.contains("line", F.lit(" the ")))
    patched = t("documents").where("doc_id % 5 = 0").select("doc_id", F.lit(0).cast("long").alias("line_no"))
    return search.overridden(lines.select("doc_id", "line_no"), patched, ["doc_id"])


@query(
    """with o as (select user_id, event_type, value, event_id, row_number() over (partition by user_id, event_type order by value, event_id) as a, row_number() over (partition by user_id, event_type order by value desc, event_id) as b,
min(event_type) over (partition by user_id) as f from events)
select user_id, event_type, event_id, a = 1 as narrow, b = 1 and event_type = f and value >= 8 as broad from o where a = 1 or (b = 1 and event_type = f and value >= 8)"""
)
def search_choice(t):
    rows = search.chosen(t("events"), ["user_id"], "event_type", "event_id", "value", broad=True)
    return rows.select("user_id", "event_type", "event_id", "narrow", "broad")


@query(
    """with e as (select *, row_number() over (partition by user_id order by ts, event_id) as k from events),
s as (select user_id, event_type, min(k) filter (where value > 50) as f from e group by 1, 2)
select event_id from e join s using (user_id, event_type) where f is null or k <= f"""
)
def until_shown(t):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t("events").withColumn("k", k).withColumn("shown", F.col("value") > 50)
    return search.until_shown(rows, "user_id", "k", "event_type", "shown").select("event_id")


TOK = "regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*')"


@query(
    f"""with c as (select doc_id, unnest({TOK}) as tok, generate_subscripts({TOK}, 1) as i from documents),
p as (select doc_id, i, 0 as j, tok from c union all select doc_id, i, j, part from (select doc_id, i, unnest(string_split(tok, '.')) as part, generate_subscripts(string_split(tok, '.'), 1) as j from c where contains(tok, '.'))),
k as (select doc_id, i, j, tok, contains(tok, '_')::int + contains(tok, '.')::int as score from p where length(tok) between 4 and 60 and (contains(tok, '_') or contains(tok, '.') or regexp_matches(tok, '[a-z][A-Z]'))
  and lower(tok) not in ({", ".join(f"'{w}'" for w in search.STOP_WORDS)})),
b as (select doc_id, tok, max(score) as score, min((i, j)) as f from k group by 1, 2)
select doc_id, tok as token, score, rank from (select *, row_number() over (partition by doc_id order by score desc, f) as rank from b) where rank <= 14"""
)
def candidate_names(t):
    return search.candidates(t("documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "token", "score", F.col("rank").cast("long").alias("rank"))


@query(
    """with l as (select doc_id, string_split(text, chr(10)) as ls from documents), n as (select *, case when ls[-1] = '' then len(ls) - 1 else len(ls) end as n from l),
w as (select *, least(3, n) as last from n)
select doc_id, case when n < 2 then 'error: no lines in range 2-3 for f' else array_to_string(list_transform(range(2, last + 1), lambda i: i || ': ' || ls[i]), chr(10)) end as shown from w"""
)
def read_windows(t):
    return t("documents").select("doc_id", compaction.read_lines(F.col("text"), F.lit(2), F.lit(3), F.lit("f")).alias("shown"))


@query(
    """with b as (select doc_id, 'h' || chr(10) || chr(10) || text as t, text from documents)
select doc_id, md5(case when length(text) > 3000 then 'h' || chr(10) || chr(10) || left(text, 1500) || chr(10) || '... output truncated ...' || chr(10) || right(text, 1500) else t end) as cut from b"""
)
def cut_outputs(t):
    return t("documents").select("doc_id", F.md5(text.truncate_body(F.concat(F.lit("h\n\n"), "text"))).alias("cut"))


@query(
    """select page_id, 'a' || chr(10) || 'b' || chr(10) || '/home/user/x/y' || page_id || ' c:\\d ' || '/workspace/m.py' as clean from pages"""
)
def clean_hosts(t):
    noise = F.concat(F.lit("a\r\nwarnings=x\nb\r"), F.format_string("C:\\Users\\me\\x\\y%d", "page_id"), F.lit(" c:\\\\\\d "), F.lit("D:\\Users\\me\\Desktop\\p\\replay\\r1\\repo\\m.py\nunsupported_limits=z"))
    return t("pages").select("page_id", text.clean_observation(noise, "/workspace", r"Desktop\\p\\replay").alias("clean"))


COMPACTED = """with d as (select doc_id, string_split(text, chr(10)) as l, len(string_split(text, chr(10))) as n from documents),
m as (select *, n // 2 + 1 as mid, ('0x' || substr(sha256('0:' || doc_id), 1, 8))::bigint / 4294967296.0::double < 0.5 as drawn from d),
s as (select *, greatest(1, mid - 40) as a, least(n, mid + 40) as b from m),
w as (select *, not (a = 1 and b = n) as cut, l[mid] as old from s)
select doc_id, case when cut then a end::int as first, case when cut then b end::int as last,
  md5(case when cut then array_to_string(list_transform(range(a, b + 1), lambda i: lpad(i::varchar, length(b::varchar)::int, ' ') || ': ' || l[i]), chr(10))
    else array_to_string(list_transform(range(1, n + 1), lambda i: i || ': ' || l[i]), chr(10)) end) as shown,
  drawn and old <> '' as recovered, (case when drawn and old <> '' then 7 else 5 end)::int as n_messages from w"""


@query(COMPACTED)
def compacted_transcripts(t):
    """Transcripts of a read, an edit of the line in the middle and a submit, made of documents' lines, compacted."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = t("documents").select("doc_id", lines.alias("l"))
    numbered = F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")
    mid = F.floor(F.size("l") / 2).cast("int")
    diff = F.concat(F.lit("--- a/m\n+++ b/m\n@@ -"), (mid + 1).cast("string"), F.lit(" +"), (mid + 1).cast("string"), F.lit(" @@\n-"), F.get("l", mid), F.lit("\n+new"))
    call = lambda name, arguments: F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"), F.array(F.struct(F.lit("c").alias("id"), F.struct(F.lit(name).alias("name"), arguments.alias("arguments")).alias("function"))).alias("tool_calls"))
    tool = lambda content: F.struct(F.lit("tool").alias("role"), content.alias("content"), F.array().cast("array<struct<id:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"))
    args = lambda **k: F.to_json(F.struct(*[v.alias(n) for n, v in k.items()]))
    messages = F.array(call("read_file", args(path=F.lit("m"))), tool(numbered), call("edit_file", args(path=F.lit("m"), diff=diff)), tool(F.lit("ok")), call("submit", args(note=F.lit("x"))))
    out = compaction.compact(rows.select("doc_id", messages.alias("messages")), "doc_id", recovery_rate=0.5)
    read = F.get("messages", F.lit(0))["tool_calls"][0]["function"]["arguments"]
    number = lambda k: F.get_json_object(read, f"$.{k}").cast("int")
    return out.select(
        "doc_id", number("start_line").alias("first"), number("end_line").alias("last"), F.md5(F.get("messages", F.lit(1))["content"]).alias("shown"),
        F.col("meta.recovery_example").alias("recovered"), F.size("messages").alias("n_messages"),
    )


# ---------------------------------------------------------------- reports and joins


@query(
    """with a as (select doc_id, quality = 1 as ok from labels), t as (select doc_id, arg_max(quality = 1, toxic) as ok from labels group by 1), b as (select doc_id, arg_max(toxic = 1, quality) as ok from labels group by 1)
select count(*) as n, count_if(t.ok and b.ok)::bigint as both, count_if(not t.ok and not b.ok)::bigint as neither, count_if(t.ok and not b.ok)::bigint as treatment_only, count_if(not t.ok and b.ok)::bigint as baseline_only from t join b using (doc_id)"""
)
def paired_arms(t):
    one = t("labels").select("doc_id", F.col("toxic").alias("o"), (F.col("quality") == 1).alias("ok"))
    two = t("labels").select("doc_id", F.col("quality").alias("o"), (F.col("toxic") == 1).alias("ok"))
    return episodes.paired_arms(one, two, "doc_id", "o", "ok").drop("log10_p")


@query(f"select count(*) as n, count_if(quality = 1)::bigint as resolved, round(count_if(quality = 1) / count(*)::double, 6) as rate, {_wilson_sql('count_if(quality = 1)', 'count(*)')} from labels where doc_id in (select doc_id from documents where doc_id % 3 = 0)")
def arm_report(t):
    ids = t("documents").where("doc_id % 3 = 0").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_semi")
    return episodes.summary(episodes.arm(t("labels"), ids, "doc_id"), F.col("quality") == 1)


@query("select doc_id, source from documents where doc_id in (select doc_id from labels)")
def wanted_rows(t):
    return t("documents").select("doc_id", "source").join(t("labels").select("doc_id"), "doc_id", "left_semi")


@query("select doc_id from documents where doc_id not in (select doc_id from labels) order by doc_id limit 50 offset 10")
def pending_page(t):
    left = t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")
    return tasks.page(left, ["doc_id"], 50, 10)


@query("select n_nationkey, n_name, case when n_regionkey % 2 = 0 then r_name else 'pytest' end as runner from nation join region on n_regionkey = r_regionkey")
def runner_lookup(t):
    setup = t("region").where("r_regionkey % 2 = 0").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("runner"))
    return tasks.with_setup(t("nation"), setup, "n_regionkey", {"runner": "pytest"}).select("n_nationkey", "n_name", "runner")


@query(
    f"""with s as (select doc_id, text, {SPLIT} as split from documents), a as (select 'text' as what, md5(text) as key, list(distinct split order by split) as splits from s group by text),
b as (select 'id' as what, doc_id::varchar as key, list(distinct split order by split) as splits from s group by doc_id)
select what, key, array_to_string(splits, ',') as splits from (select * from a union all select * from b) where len(splits) > 1"""
)
def split_overlap(t):
    """Texts that stand in more than one split, and ids, of which there are none."""
    rows = tasks.assign_split(t("documents"), F.col("doc_id")).select(F.col("doc_id").cast("string").alias("id"), F.md5("text").alias("text"), "split")
    found = [tasks.shared_between(rows.select(F.col(c).alias("key"), "split"), "split", "key").select(F.lit(c).alias("what"), "key", F.array_join("splits", ",").alias("splits")) for c in ("text", "id")]
    return found[0].unionByName(found[1])


@query(
    "select queue, count(*) as n, sum(doc_id)::bigint as total from (select case when quality = 1 then 0 else 1 end as queue, doc_id from labels) group by 1"
)
def queued_tasks(t):
    """Tasks of two queues as one bag: those that run one after another, then those that run side by side."""
    rows = t("labels").select("doc_id", "quality")
    both = tasks.queued(rows.where("quality = 1"), rows.where("quality != 1"))
    return both.groupBy("queue").agg(F.count("*").alias("n"), F.sum("doc_id").alias("total"))


@query(
    """(select event_type, value, 'first' as side from events where event_id % 2 = 0 except all select event_type, value, 'first' from events where event_id % 3 = 0)
union all (select event_type, value, 'second' as side from events where event_id % 3 = 0 except all select event_type, value, 'second' from events where event_id % 2 = 0)"""
)
def disagreements(t):
    side = lambda k: t("events").where(F.col("event_id") % k == 0).select("event_type", "value")
    return search.disagreements(side(2), side(3))


@query("select p_partkey, round_even(p_retailprice / 8, 1)::double as one, printf('%.1f%%', p_size * 100 / 64.0) as share from part")
def rounded_numbers(t):
    price = F.bround(F.col("p_retailprice").cast("decimal(18,6)") / 8, 1).cast("double")
    return t("part").select("p_partkey", price.alias("one"), F.format_string("%.1f%%", F.bround(F.col("p_size") * 100 / 64.0, 1)).alias("share"))


@query(
    f"""with s as (select count(*) as n, count_if(quality = 1) as k from labels), c as (select case when quality = 1 then 'resolved' else 'wrong_file' end as category, count(*) as n from labels group by 1)
select (select 'tasks ' || n || ', resolved ' || k || printf(' (%.1f%%, 95%% ', k * 100.0 / n) from s) as head, string_agg('  ' || category || ': ' || n, chr(10) order by n desc, category) as lines from c"""
)
def text_report(t):
    kind = F.when(F.col("quality") == 1, "resolved").otherwise("wrong_file")
    counts = t("labels").groupBy(kind.alias("category")).agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("category", "n")).alias("categories"))
    whole = episodes.summary(t("labels"), F.col("quality") == 1).select(F.struct("*").alias("s")).crossJoin(counts)  # one row each
    report = whole.select(episodes.report_text(F.col("s"), F.col("categories")).alias("r"))
    first = F.substring_index("r", "\n", 1)
    return report.select(F.regexp_extract(first, r"^(.*95% )", 1).alias("head"), F.substr("r", F.length(first) + 2).alias("lines"))


@query("select user_id, array_to_string(list_concat(a[1:8], case when len(a) > 8 then ['...'] else [] end), chr(10)) as listing from (select user_id, list('f' || event_id order by 'f' || event_id) as a from events group by 1)")
def file_listings(t):
    rows = t("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.format_string("f%d", "event_id"))).alias("a"))
    return rows.select("user_id", search.listing_text(F.col("a"), 8).alias("listing"))


@query("select event_id, case event_id % 3 when 0 then 'The search for x(y) found 3 lines.' when 1 then 'The edit of x(y) changes 3 lines.' else 'Lines of x(y) around the change: 3.' end as note from events")
def step_notes(t):
    kind = F.when(F.col("event_id") % 3 == 0, "search").when(F.col("event_id") % 3 == 1, "edit").otherwise("read")
    return t("events").select("event_id", search.note(kind, F.lit("x{y}"), F.lit(3)).alias("note"))


# ---------------------------------------------------------------- runs, edits, transcripts


@query(
    """select event_id, case when event_id % 5 = 0 then 'error' when event_id % 5 = 1 then 'timeout' when event_id % 7 = 0 then 'pass' else 'fail' end as status from events"""
)
def run_statuses(t):
    i = F.col("event_id")
    return t("events").select("event_id", runs.run_status(i % 5 != 0, i % 5 == 1, (i % 7).cast("int")).alias("status"))


@query(
    """select doc_id, 'error' as status, 0 as steps, coalesce(quality = 1, false) as resolved, case when doc_id % 2 = 0 then 'pip install failed' else 'not run' end as reason
from documents left join (select doc_id, max(quality) as quality from labels group by 1) using (doc_id)"""
)
def record_defaults(t):
    seen = t("labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("resolved"))
    rows = t("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "pip install failed").alias("error")).join(seen, "doc_id", "left")
    return runs.with_defaults(rows).select("doc_id", "status", "steps", "resolved", "reason")


@query(
    """select event_id, case event_id % 6 when 0 then 'diff must not be empty' when 1 then 'path escapes the repository: ../x' when 2 then 'diff touches 2 files (a/x, b/y); edit one file per call'
when 3 then 'diff is for ''a/x'' but path is ''a/z''; refusing to apply' when 4 then 'parent directory does not exist for: q/x' end as error from events"""
)
def edit_checks(t):
    i = F.col("event_id") % 6
    path = F.when(i == 1, "../x").when(i == 3, "a/z").when(i == 4, "q/x").otherwise("a/x")
    diff = F.when(i == 0, " \n\t").when(i == 2, "+++ b/a/x\n@@\n+++ b/b/y\n").otherwise("+++ b/a/x\n@@\n")
    rows = t("events").select("event_id", path.alias("path"), diff.alias("diff")).withColumn("targets", runs.diff_targets("diff"))
    return rows.select("event_id", runs.edit_error(F.col("path"), F.col("diff"), F.col("targets"), F.lit(False), F.col("path") != "q/x").alias("error"))


@query(
    """select doc_id, 'f' || doc_id as path, text <> '' as ok, case when text <> '' then md5('changed' || substr(text, length(split_part(text, chr(10), 1)) + 1)) end as digest from documents"""
)
def patched_trees(t):
    rows = t("documents").select("doc_id", F.format_string("f%d", "doc_id").alias("path"), "text")
    diff = F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n@@ -1 +1 @@\n-"), F.substring_index("text", "\n", 1), F.lit("\n+changed"))
    out = runs.apply_to_tree(rows, rows.select("doc_id", diff.alias("diff")), "doc_id")
    return out.select("doc_id", "path", "ok", F.md5("text").alias("digest"))


@query(
    """with e as (select user_id, event_type, json_extract(props, '$.k')::int as k, event_id % 90 + 1 as s from events)
select user_id, event_type, min(s)::int as low, max(s + greatest(k, 1) - 1)::int as high from e group by 1, 2"""
)
def hunk_envelopes(t):
    diff = F.format_string("--- a/x\n+++ b/x\n@@ -%d,%s +1 @@ f\n x", F.col("event_id") % 90 + 1, F.get_json_object("props", "$.k"))
    return runs.hunk_envelopes(t("events").select("user_id", "event_type", diff.alias("diff")), ["user_id", "event_type"], "diff")


@query(
    f"""with l as (select doc_id, line, line_no from {LINES}), e as (select doc_id, doc_id % 7 + 3 as low, doc_id % 7 + 5 as high from documents)
select doc_id, line_no::int as n, md5(line) as line from l join e using (doc_id) where line_no between low - 2 and high + 2"""
)
def lines_around_edits(t):
    lines = F.split("text", "\n")
    listing = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")
    reads = t("documents").select("doc_id", listing.alias("text"))
    diff = F.format_string("@@ -%d,3 +1 @@", F.col("doc_id") % 7 + 3)
    edits = runs.hunk_envelopes(t("documents").select("doc_id", diff.alias("diff")), ["doc_id"], "diff")
    return runs.lines_around(reads, edits, ["doc_id"], "text", 2).select("doc_id", "n", F.md5("line").alias("line"))


@query("select user_id, array_to_string(case when list_position(a, 3) > 0 then a[1:list_position(a, 3) - 1] else a end, ',') as ids from (select user_id, list(json_extract(props, '$.k')::int % 7 order by ts, event_id) as a from events group by 1)")
def cut_generations(t):
    k = F.get_json_object("props", "$.k").cast("int") % 7
    rows = t("events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", k.alias("k")))), lambda s: s["k"]).alias("a"))
    return rows.select("user_id", F.array_join(runs.until_stop(F.col("a"), [3]), ",").alias("ids"))


@query("select event_id, 'python -m pytest ' || case when event_id % 2 = 0 then 't.py::x' else 'a b' end as argv from events")
def test_commands(t):
    words = lambda s: F.array(*map(F.lit, s.split()))
    argv = runs.test_argv(words("python -m pytest"), words("a b"), F.when(F.col("event_id") % 2 == 0, " t.py::x "))
    return t("events").select("event_id", F.array_join(argv, " ").alias("argv"))


@query("select conv_id, count(*)::int as n, md5(string_agg('[' || role || ']' || chr(10) || text, chr(10) || chr(10) order by turn)) as digest from conversations group by 1")
def flat_contexts(t):
    return _transcripts(t).select("conv_id", F.size("messages").alias("n"), F.md5(runs.flat_text(F.col("messages"))).alias("digest"))


@query("select user_id, count(*)::int as n, count_if(event_type = 'error')::int as errors, count_if(event_type <> 'error')::int as silent from events group by 1")
def transcripts_as_json(t):
    """Transcripts written as JSON, without what is empty, and read back with their defaults."""
    error = F.col("event_type") == "error"
    call = F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"), F.lit("{}").alias("arguments"), F.when(error, "why").otherwise("").alias("reasoning"), F.array().cast("array<int>").alias("completion_ids"))
    seen = F.struct(F.col("event_id").cast("string").alias("tool_call_id"), F.col("event_type").alias("name"), F.lit("c").alias("content"), F.when(error, True).alias("is_error"))
    rows = t("events").groupBy("user_id").agg(F.struct(F.array(F.lit("m")).alias("messages"), F.lit(1).alias("steps"), F.collect_list(call).alias("tool_calls"), F.collect_list(seen).alias("observations")).alias("t"))
    back = rows.select("user_id", runs.to_json(F.col("t")).alias("j")).where(~F.col("j").contains("completion_ids")).withColumn("t", runs.from_json(F.col("j")))
    count = lambda a, f: F.size(F.filter(a, f))
    return back.select("user_id", F.size("t.tool_calls").alias("n"), count("t.observations", lambda o: o["is_error"]).alias("errors"), count("t.tool_calls", lambda c: c["reasoning"] == "").alias("silent"))


@query("select l_orderkey, count_if(l_returnflag <> 'N') as n, round(sum(case when l_returnflag <> 'N' then l_tax else 0 end) / greatest(count_if(l_returnflag <> 'N'), 1), 6) as loss from lineitem group by 1")
def mean_losses(t):
    rows = runs.mean_loss(t("lineitem").withColumn("on", F.expr(ON)), "l_tax", "on", "l_orderkey")
    return rows.select("l_orderkey", "n", F.round("loss", 6).alias("loss"))


@query()
def code_changes(t):
    """Whether documents differ, taken as Python and as text, from themselves with a comment."""
    rows = t("documents").select("doc_id", "text", F.concat("text", F.lit("\n# note")).alias("after"))
    path = F.when(F.col("doc_id") % 2 == 0, "a.py").otherwise("a.txt")
    return rows.select("doc_id", runs.changes_code(path, "text", "after").alias("changed"))


@query("select conv_id, bool_or(role = 'user') as kept from conversations group by 1")
def kept_replays(t):
    name = F.when(F.col("role") == "assistant", "submit").when(F.col("role") == "user", "run_tests")
    message = F.struct("turn", F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"), name.alias("name"), F.lit("status=pass").alias("content"))
    rows = t("conversations").groupBy("conv_id").agg(F.concat(F.array_sort(F.collect_list(message)), F.array(F.struct(F.lit(99).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit("submit").alias("name"), F.lit("").alias("content")))).alias("m"))
    return rows.select("conv_id", verify.kept_replay(F.col("m")).alias("kept"))
