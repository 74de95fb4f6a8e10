"""Queries over the driver's tables, one or more for each operator, with the same in SQL.

documents are tasks, labels their verdicts (quality: resolved; toxic: the other arm), conversations transcripts, events
tool calls (an episode is a user's day), lineitem rollouts of an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, patch, text
from ..functions.stats import wilson
from ..operators import episodes, rollouts, tasks, transcripts
from ..session import ship_package
from ..streaming.ledger import event_windows

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


BUCKET = "(('0x' || substr(sha1(doc_id::varchar), 1, 8))::bigint % 100)"
SPLIT = f"case when {BUCKET} < 60 then 'sft' when {BUCKET} < 80 then 'rl' else 'holdout' end"


def _wilson_sql(k: str, n: str) -> str:
    k, n = f"({k})::double", f"({n})::double"
    mid = f"({k} / {n} + 1.96::double * 1.96 / (2 * {n})) / (1 + 1.96::double * 1.96 / {n})"
    half = f"1.96::double * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 1.96::double * 1.96 / (4 * {n} * {n})) / (1 + 1.96::double * 1.96 / {n})"
    return f"round(greatest(0, {mid} - {half}), 6) as low, round(least(1, {mid} + {half}), 6) as high"


RATES = f"count(*) as n, count_if(quality = 1)::bigint as resolved, round(count_if(quality = 1) / count(*)::double, 6) as rate, {_wilson_sql('count_if(quality = 1)', 'count(*)')}"


@query(f"select doc_id, {SPLIT} as split from documents")
def split_assign(t):
    return tasks.assign_split(t("documents"), F.col("doc_id")).select("doc_id", "split")


@query(f"select {SPLIT} as split, count(*) as n from documents group by 1")
def split_counts(t):
    return tasks.assign_split(t("documents"), F.col("doc_id")).groupBy("split").agg(F.count("*").alias("n"))


@query("select doc_id from documents order by sha1('0:' || doc_id) limit 24")
def dev_slice(t):
    return tasks.dev_slice(t("documents").select("doc_id"), F.col("doc_id"), 24)[0]


@query("select doc_id from documents where ('0x' || substr(sha256(doc_id::varchar), 1, 2))::int / 255.0 < 0.25")
def two_step_draw(t):
    return tasks.draw(t("documents").select("doc_id"), F.col("doc_id"))


@query("select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^/+|/+$', '', 'g'), '\\.git$', ''), '[^A-Za-z0-9_.-]+', '__', 'g') as slug from pages")
def slugify_url(t):
    return t("pages").select("page_id", text.slugify(F.col("url")).alias("slug"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def ledger_pending(t):
    return tasks.pending(t("documents").select("doc_id"), t("labels"), "doc_id", F.col("quality") == 1)


@query("select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1)")
def ledger_retry(t):
    return tasks.pending(t("documents").select("doc_id"), t("labels"), "doc_id", F.col("quality") == 1, retry=True)


@query("select doc_id, source, n_chars from documents join labels using (doc_id) where quality = 1")
def public_pool(t):
    pool = t("documents").select("doc_id", "source", "n_chars", F.col("text").alias("gold_patch"), F.col("lang").alias("new_gold_column"))
    return tasks.public_pool(pool, ["doc_id", "source", "n_chars"]).join(t("labels").where("quality = 1").select("doc_id"), "doc_id")


@query(
    f"""with d as (select doc_id, trim(text) as issue, source, n_chars, {SPLIT} as split from documents), o as (select * from d where split <> 'holdout')
select doc_id from d where split = 'holdout' and doc_id not in (select doc_id from o) and issue not in (select issue from o)
and not exists (select 1 from o where o.source = d.source and o.n_chars = d.n_chars)"""
)
def contam_3key(t):
    d = tasks.assign_split(t("documents"), F.col("doc_id")).select("doc_id", F.trim("text").alias("issue"), "source", "n_chars", "split")
    held, others = d.where("split = 'holdout'"), d.where("split != 'holdout'")
    return tasks.uncontaminated(held, others, [["doc_id"], ["source", "n_chars"], ["issue"]]).select("doc_id")


@query(
    """select source, rn, doc_id from (select source, doc_id, row_number() over (partition by source order by sha1('7:' || doc_id)) as rn from documents)
order by rn, source limit 24"""
)
def round_robin_24(t):
    return tasks.round_robin(t("documents").select("source", "doc_id"), "source", hashing.order_key(F.col("doc_id"), 7), 24)


@query(
    """select source, doc_id, ((row_number() over (partition by source order by doc_id) - 1) // 16)::bigint as shard from documents"""
)
def shard_slices(t):
    return tasks.shards(t("documents").select("source", "doc_id"), "source", "doc_id", 16)


@query("select arg_max(doc_id, n_chars * 1000000 + doc_id) as doc_id, source from documents group by source")
def last_wins(t):
    d = t("documents").select("source", "doc_id", (F.col("n_chars") * 1000000 + F.col("doc_id")).alias("o"))
    return tasks.last_wins(d, ["source"], "o").select("source", "doc_id")


@query(f"select {RATES} from labels")
def eval_summary(t):
    return episodes.summary(t("labels"), F.col("quality") == 1)


@query(f"select coalesce(source, '*') as source, {RATES} from documents join labels using (doc_id) group by grouping sets ((source), ())")
def per_repo_report(t):
    d = t("documents").select("doc_id", "source").join(t("labels"), "doc_id")
    return episodes.per_group(d, "source", F.col("quality") == 1)


@query(f"select source, {_wilson_sql('count_if(quality = 1)', 'count(*)')} from documents join labels using (doc_id) group by source")
def wilson_by_repo(t):
    d = t("documents").select("doc_id", "source").join(t("labels"), "doc_id").groupBy("source")
    d = d.agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return d.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    """with c as (select count(*) as n, count_if(quality = 1 and toxic = 1)::bigint as both, count_if(quality <> 1 and toxic <> 1)::bigint as neither,
count_if(quality = 1 and toxic <> 1)::bigint as treatment_only, count_if(quality <> 1 and toxic = 1)::bigint as baseline_only from labels),
k as (select treatment_only + baseline_only as n, least(treatment_only, baseline_only) as k from c),
lt as (select i, lgamma(k.n + 1) - lgamma(i + 1) - lgamma(k.n - i + 1) - k.n * ln(2::double) as l from k, range(0, 100000) r(i) where i <= k.k),
p as (select (max(l) + ln(sum(exp(l - (select max(l) from lt)))) + ln(2::double)) / ln(10::double) as p from lt)
select c.*, round(least(0, p), 6) as log10_p from c, p"""
)
def paired_mcnemar(t):
    return episodes.paired(t("labels"), F.col("quality") == 1, F.col("toxic") == 1)


@query(
    """select 'attempted' as sample, count(*) as n, count_if(quality = 1)::bigint as resolved from labels union all
select 'effective', count(*), count_if(quality = 1)::bigint from labels where not (quality = 0 and toxic = 1) union all
select 'clean', count(*), count_if(quality = 1)::bigint from labels where toxic = 0"""
)
def nested_samples(t):
    kinds = F.filter(
        F.array(
            F.lit("attempted"),
            F.when(~((F.col("quality") == 0) & (F.col("toxic") == 1)), F.lit("effective")),
            F.when(F.col("toxic") == 0, F.lit("clean")),
        ),
        lambda x: x.isNotNull(),
    )
    rows = t("labels").withColumn("sample", F.explode(kinds))
    return rows.groupBy("sample").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("resolved"))


@query("select conv_id, sum(length(text))::bigint as size from conversations group by conv_id")
def traj_sizes(t):
    return transcripts.sizes(t("conversations"), "conv_id", F.col("text"))


@query(
    """with s as (select conv_id, sum(length(text))::bigint as size from conversations group by conv_id),
o as (select list(size order by size) as a, count(*) as m from s),
j as (select *, least(greatest(9 * (m + 1) // 10, 1), m - 1) as j from o)
select ((a[(m + 1) // 2] + a[m // 2 + 1]) / 2.0)::double as median,
round(((a[j] * (10 - (9 * (m + 1) - 10 * j)) + a[j + 1] * (9 * (m + 1) - 10 * j)) / 10.0)::double, 6) as p90, a[m] as max from j"""
)
def size_quantiles(t):
    return transcripts.size_quantiles(transcripts.sizes(t("conversations"), "conv_id", F.col("text")), "size")


@query(
    """select conv_id, turn from (select *, lag(role) over (partition by conv_id order by turn) as p from conversations)
where role = 'assistant' and p = 'user'"""
)
def adjacent_pairs(t):
    return transcripts.adjacent(t("conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role", "user", "assistant")[["conv_id", "turn"]]


SPAN = "(sum(length(text)) over (partition by conv_id order by turn))::bigint"


@query(f'select conv_id, turn, {SPAN} - length(text) as "begin", {SPAN} as "end", role = \'assistant\' as train from conversations')
def prefix_spans(t):
    c = transcripts.prefix_spans(t("conversations"), "conv_id", "turn", F.length("text"), F.col("role") == "assistant")
    return c.select("conv_id", "turn", "begin", "end", "train")


@query(
    """with s as (select *, sum(length(text)) over (partition by conv_id order by turn rows between current row and unbounded following) as s from conversations)
select conv_id, coalesce(min(turn) filter (where s <= 1500), max(turn)) as start, bool_or(s <= 1500) as fits from s where role = 'assistant' group by conv_id"""
)
def fit_first(t):
    return transcripts.first_fitting_suffix(t("conversations"), "conv_id", "turn", F.length("text"), F.col("role") == "assistant", 1500)


@query(
    """select conv_id, turn, used from (select conv_id, turn, (sum(length(text) + 1) over (partition by conv_id order by turn))::bigint as used from conversations)
where used <= 1000"""
)
def budget_take(t):
    return transcripts.budget_take(t("conversations"), "conv_id", "turn", F.length("text"), 1000).select("conv_id", "turn", "used")


@query(
    """with e as (select *, case when lag(event_type) over w = event_type then 0 else 1 end as n from events window w as (partition by user_id order by ts, event_id)),
r as (select user_id, sum(n) over (partition by user_id order by ts, event_id) as r from e), c as (select user_id, r, count(*) as c from r group by 1, 2)
select user_id, max(c) as longest_run, max(c) >= 3 as repeats from c group by user_id"""
)
def identical_runs(t):
    return episodes.longest_runs(t("events"), ["user_id"], ["ts", "event_id"], "event_type")


EPISODES = "(select user_id, ts::date as day, count(*) as n, count(distinct event_type) as kinds, bool_or(event_type = 'purchase') as bought from events group by 1, 2)"


def _episodes(t) -> DataFrame:
    return t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.bool_or(F.col("event_type") == "purchase").alias("bought")
    )


@query(f"select count(*) as episodes, count_if(n >= 4)::bigint as long, count_if(n >= 4 and kinds <= 3)::bigint as stuck from {EPISODES}")
def stuck_episodes(t):
    e = _episodes(t)
    return e.agg(F.count("*").alias("episodes"), F.count_if(F.col("n") >= 4).alias("long"), F.count_if((F.col("n") >= 4) & (F.col("kinds") <= 3)).alias("stuck"))


@query("select event_type, count(*) as n, round(count(*) / sum(count(*)) over ()::double, 6) as share from events group by 1")
def tool_mix(t):
    e = t("events").groupBy("event_type").agg(F.count("*").alias("n"))
    return e.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("select event_type, round(median(value), 6) as median, max(value) as largest from events group by 1")
def token_median(t):
    return t("events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"), F.max("value").alias("largest"))


@query(f"select user_id, day::varchar as day from {EPISODES} where not bought")
def never_submit(t):
    return _episodes(t).where("not bought").select("user_id", F.col("day").cast("string").alias("day"))


@query(
    """with e as (select *, max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as b from events)
select user_id, count_if(b is null or value > b)::bigint as n_best, max(value) as best from e group by user_id"""
)
def running_best(t):
    return episodes.running_best(t("events"), "user_id", ["ts", "event_id"], "value")


RESOLVED, INFRA = "l_returnflag = 'R'", "l_linestatus = 'O'"
BASE = f"(case when {RESOLVED} then 1.0::double else 0 end - 0.1::double * (case when l_tax > 0 then 0 else 1 end))"
SHAPE = "(0.15::double * (case when l_discount > 0 then 1 else 0 end) - 0.005::double * l_quantity)"


def _rollouts(t) -> DataFrame:
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_tax", "l_discount")
    return rollouts.components(rows, F.expr(RESOLVED), F.col("l_discount") > 0, F.col("l_quantity"), F.col("l_tax") > 0)


@query(f"select l_orderkey, l_linenumber, round({BASE} + {SHAPE}, 6) + 0 as reward from lineitem")
def rewards(t):
    return _rollouts(t).select("l_orderkey", "l_linenumber", F.round("reward", 6).alias("reward"))


@query(
    f"""with g as (select *, bool_or({RESOLVED} and not {INFRA}) over (partition by l_orderkey) as gated from lineitem)
select l_orderkey, l_linenumber, gated, round({BASE} + case when gated then {SHAPE} else 0 end, 6) + 0 as train_reward from g"""
)
def gated_rewards(t):
    r = rollouts.gated_reward(_rollouts(t), "l_orderkey", F.expr(RESOLVED), F.expr(INFRA))
    return r.select("l_orderkey", "l_linenumber", "gated", F.round("train_reward", 6).alias("train_reward"))


MINE = f"case when not ({INFRA}) then l_extendedprice end"


@query(f"select l_orderkey, l_linenumber, round(coalesce({MINE} - avg({MINE}) over (partition by l_orderkey), 0), 6) + 0 as advantage from lineitem")
def advantages(t):
    r = rollouts.advantage(t("lineitem"), "l_orderkey", F.col("l_extendedprice"), F.expr(INFRA))
    return r.select("l_orderkey", "l_linenumber", F.round("advantage", 6).alias("advantage"))


@query(
    f"""with s as (select *, {MINE} as m, avg({MINE}) over w as a, stddev_pop({MINE}) over w as s from lineitem window w as (partition by l_orderkey))
select l_orderkey, l_linenumber, round(coalesce(case when s < 1e-8 then 0 else (m - a) / (s + 1e-8::double) end, 0), 6) + 0 as advantage from s"""
)
def advantages_std(t):
    r = rollouts.advantage(t("lineitem"), "l_orderkey", F.col("l_extendedprice"), F.expr(INFRA), scale=True)
    return r.select("l_orderkey", "l_linenumber", F.round("advantage", 6).alias("advantage"))


@query("select l_orderkey, l_linenumber, round(exp(l_tax - l_discount) - (l_tax - l_discount) - 1, 6) + 0 as kl from lineitem")
def kl_terms(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(rollouts.kl_term(F.col("l_discount"), F.col("l_tax")), 6).alias("kl"))


LINES = "(select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from (select doc_id, string_split(text, chr(10)) as ls from documents))"


@query(f"select doc_id, count(*) as hits, min(line_no)::bigint as first_line, count(*) >= 25 as truncated from {LINES} where contains(lower(line), 'the') group by doc_id")
def search_hits(t):
    rows = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    found = rows.where(F.contains(F.lower("line"), F.lit("the"))).groupBy("doc_id")
    return found.agg(F.count("*").alias("hits"), (F.min("i") + 1).cast("long").alias("first_line"), (F.count("*") >= 25).alias("truncated"))


@query(
    """select token, count(*) as n, min(doc_id) as first_doc from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*')) as token
from documents) where length(token) between 4 and 60 group by token"""
)
def identifiers(t):
    tokens = F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"), F.lit(0))
    rows = t("documents").select("doc_id", F.explode(tokens).alias("token"))
    return rows.where(F.length("token").between(4, 60)).groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


TARGET = "greatest(200, floor(length(text) * 0.5)::int)"
HEAD = f"floor({TARGET} * 0.65::double / 0.8::double)::int"


@query(
    f"""select doc_id, md5(left(text, {HEAD}) || chr(10) || '...[' || (length(text) - {TARGET}) || ' chars truncated]...' || chr(10) || right(text, {TARGET} - {HEAD})) as shrunk
from documents where length(text) > 3000"""
)
def middle_shrink(t):
    return t("documents").where(F.length("text") > 3000).select("doc_id", F.md5(text.middle_shrink(F.col("text"))).alias("shrunk"))


@query("select page_id, translate(regexp_replace(regexp_replace(html, '\\r\\n', chr(10), 'g'), '\\\\{2,}', '\\\\', 'g'), '{}', '()') as html from pages")
def clean_obs(t):
    return t("pages").select("page_id", text.braces_to_parens(text.clean_observation(F.col("html"))).alias("html"))


@query("select time_bucket(interval 1 hour, ts) as window_start, count(*) as n, round(sum(value), 4) as total from events group by 1")
def event_windows_hourly(t):
    return event_windows(t("events"))


@query("select user_id, event_type, json_extract(props, '$.k')::int as k, count(*) as n from events group by 1, 2, 3")
def tool_args(t):
    return t("events").groupBy("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query(
    """with a as (select doc_id from labels where quality = 1), b as (select doc_id from labels where toxic = 1)
select (select count(*) from (select * from a union select * from b)) as either, (select count(*) from (select * from a intersect select * from b)) as both,
(select count(*) from (select * from a except select * from b)) as only_first"""
)
def set_operations(t):
    ids = t("labels").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("a"), F.bool_or(F.col("toxic") == 1).alias("b"))
    return ids.agg(F.count_if(F.col("a") | F.col("b")).alias("either"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"))


@query(
    """with d as (select doc_id, text, string_split(text, chr(10)) as l from documents), n as (select *, len(l) - case when l[-1] = '' then 1 else 0 end as n from d)
select doc_id, n > 0 as ok, 1 as n_sections, case when n > 1 then md5(l[1] || chr(10) || 'changed' || substr(text, length(l[1]) + length(l[2]) + 2)) when n = 1 then md5('changed' || substr(text, length(l[1]) + 1)) end as digest from n"""
)
def patch_round_trip(t):
    """Every document with its second line, or its only one, replaced by a diff."""
    lines = F.split("text", "\n")
    d = t("documents").select("doc_id", "text", lines.alias("l"), (F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)).alias("n"))
    two = F.concat(F.lit("@@ -1,2 +1,2 @@\n "), F.get("l", F.lit(0)), F.lit("\n-"), F.get("l", F.lit(1)), F.lit("\n+changed"))
    one = F.concat(F.lit("@@ -1 +1 @@\n-"), F.get("l", F.lit(0)), F.lit("\n+changed"))
    diff = F.concat(F.lit("--- a/x\n+++ b/x\n"), F.when(F.col("n") > 1, two).otherwise(one))
    return d.withColumn("r", patch.apply_diff("text", diff)).select("doc_id", "r.ok", F.size(patch.diff_sections(diff)).alias("n_sections"), F.md5("r.text").alias("digest"))


from . import files, records, searching  # noqa: E402, F401  register their queries
