"""Queries of files, ledgers and streams that Spark writes from the driver's tables and reads again, with the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import episodes, labels, runs, tokenized
from ..sources import lines
from ..stored import shared_folder, stored
from ..streaming.episodes import outcome_stream, outcomes
from ..streaming.snapshots import Ledger, pending
from .catalog import query


def _folder(t) -> str:
    spark = t("region").sparkSession
    return f"{shared_folder(spark)}/skein-files-{uuid.uuid4().hex}"


def _json_lines(df: DataFrame, path: str, *order: str) -> str:
    """df as JSON lines in order, over as many files as its sort makes ranges, their names in that order too."""
    df.orderBy(*order).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return path


@query(
    """with a as (select conv_id, turn, row_number() over (order by conv_id, turn) - 1 as position from conversations),
b as (select conv_id, md5(text) as digest, row_number() over (order by turn, conv_id) - 1 as position from conversations where role <> 'system')
select position, a.conv_id, turn, b.conv_id as other, digest from a join b using (position)"""
)
def positional_join(t):
    """Two files of unequal length and order of their own, joined line by line."""
    spark, folder = t("region").sparkSession, _folder(t)
    left = _json_lines(t("conversations").select("conv_id", "turn"), f"{folder}/results", "conv_id", "turn")
    right = t("conversations").where("role != 'system'").select("conv_id", "turn", "text")
    right = _json_lines(right, f"{folder}/trajectories", "turn", "conv_id")
    joined, _ = lines.zipped(spark, left, right, "conv_id long, turn long", "conv_id long, text string")
    return joined.select("position", "left.conv_id", "left.turn", F.col("right.conv_id").alias("other"), F.md5("right.text").alias("digest"))


CALLS = """c as (select conv_id, turn, case role when 'user' then 'read_file' when 'assistant' then 'edit_file' else 'submit' end as name,
  length(text) % 2 as k, case role when 'user' then 'read_file' when 'assistant' then 'edit_file' else 'submit' end || '/' || (length(text) % 2) as sig from conversations)"""


@query(
    f"""with {CALLS}, n as (select count(distinct conv_id) as n from conversations), m as (select count(distinct conv_id) as m from conversations where conv_id > 1),
o as (select conv_id, row_number() over (order by conv_id) as p from (select distinct conv_id from conversations where conv_id > 1)),
q as (select c.* from c join o using (conv_id) where p <= (select n from n) and conv_id % 10 <> 3),
r as (select *, case when lag(sig) over w = sig then 0 else 1 end as new from q window w as (partition by conv_id order by turn)),
i as (select *, sum(new) over (partition by conv_id order by turn) as run from r),
l as (select conv_id, max(n) as longest from (select conv_id, run, count(*) as n from i group by 1, 2) group by 1),
p as (select conv_id, count(*) as n, count(distinct sig) as kinds, count_if(name = 'submit') as submits, count_if(name = 'read_file') as reads, count_if(name = 'read_file' and k > 0) as ranged from q group by 1)
select count(*) as episodes, sum(n)::bigint as calls, sum(submits)::bigint as submits, count_if(submits = 0)::bigint as never_submit, sum(ranged)::bigint as ranged_reads,
(sum(reads) - sum(ranged))::bigint as whole_reads, count_if(longest >= 3)::bigint as repeated, count_if(n >= 4)::bigint as long, count_if(n >= 4 and kinds <= 3)::bigint as stuck,
(select n from n) as n_results, (select m from m) as n_trajectories, (select n from n) - (select m from m) as n_cut from p join l using (conv_id)"""
)
def arm_behaviour(t):
    """Conversations as trajectories: two are missing at the front, one of ten is null; keys of equal arguments change places."""
    spark, folder = t("region").sparkSession, _folder(t)
    k = F.length("text") % 2
    swapped = F.when(F.col("turn") % 2 == 0, F.format_string('{"start_line":%d,"end_line":%d}', k, k)).otherwise(F.format_string('{"end_line": %d, "start_line": %d}', k, k))
    name = F.when(F.col("role") == "user", "read_file").when(F.col("role") == "assistant", "edit_file").otherwise("submit")
    call = F.struct("turn", F.struct(name.alias("name"), swapped.alias("arguments")).alias("c"))
    calls = F.transform(F.array_sort(F.collect_list(call)), lambda x: x["c"])
    rows = t("conversations").groupBy("conv_id").agg(F.lit("submitted").alias("status"), calls.alias("tool_calls"))
    left = _json_lines(rows.select("conv_id", "status"), f"{folder}/results", "conv_id")
    traj = rows.where("conv_id > 1").select("conv_id", F.when(F.col("conv_id") % 10 != 3, F.col("tool_calls")).alias("tool_calls"))
    right = _json_lines(traj, f"{folder}/trajectories", "conv_id")
    joined, counts = lines.zipped(spark, left, right, "conv_id long", "tool_calls array<struct<name: string, arguments: string>>")
    counts = counts.select(F.col("n_left").alias("n_results"), F.col("n_right").alias("n_trajectories"), "n_cut")
    return episodes.arm_behaviour(joined, counts)


KIND = "case event_type when 'purchase' then 'submit' when 'error' then 'error' when 'signup' then 'malformed' else 'call' end"
ENDS = f"""with s as (select user_id, {KIND} as kind, row_number() over (partition by user_id order by ts, event_id) as k from events),
b as (select *, count_if(kind = 'malformed') over (partition by user_id order by k) as bad from s),
e as (select *, case when kind = 'submit' then 'submitted' when kind = 'error' or (kind = 'malformed' and bad > 2) then 'error' when k = 6 then 'budget_exhausted' end as status from b),
l as (select user_id, min(k) filter (where status is not null) as last from e group by 1)
select user_id, count_if(kind in ('call', 'submit'))::int as steps, count_if(kind = 'malformed')::int as malformed, coalesce(max(status), 'budget_exhausted') as status
from e join l using (user_id) where last is null or k <= last group by 1"""


def _steps(t) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "submit").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "malformed").otherwise("call")
    return t("events").select("user_id", "ts", F.struct("ts", "event_id").alias("at"), kind.alias("kind"))


@query(ENDS)
def episode_loop(t):
    return outcomes(_steps(t), "user_id", "at", "kind", 6)


@query(ENDS)
def streamed_episodes(t):
    """The same from a stream: steps come in order of a hash, and each episode that does not end is ended by its timer."""
    spark, folder = t("region").sparkSession, _folder(t)
    number = (F.row_number().over(Window.partitionBy("user_id").orderBy("at")) - 1).cast("int")
    rows = _steps(t).select("user_id", "ts", "kind", number.alias("step"))
    later = t("events").agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), (F.col("ts") + F.expr("interval 400 days")).alias("ts"), F.lit("submit").alias("kind"), F.lit(0).alias("step"))
    rows.unionByName(later).repartition(F.xxhash64("user_id", "step")).write.parquet(f"{folder}/steps")
    source = spark.readStream.schema(spark.read.parquet(f"{folder}/steps").schema).parquet(f"{folder}/steps")
    ended = outcome_stream(source, "user_id", "step", "kind", "ts", 6, stall="100 days")
    ended.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/ended").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ended.schema).parquet(f"{folder}/ended").where("user_id >= 0")


@query(
    """with a as (select doc_id, quality = 1 as verified from labels where toxic = 0)
select d.doc_id, case when a.verified then true when l.doc_id is not null then toxic = 1 end as verified, not coalesce(a.verified or toxic = 1, false) as pending
from documents d left join labels l using (doc_id) left join a using (doc_id)"""
)
def ledger_snapshots(t):
    """Verdicts in two appends, the second of which opens rejected ones again; then compacted, read, and asked for what is left."""
    spark, folder = t("region").sparkSession, _folder(t)
    ledger = Ledger(spark, f"{folder}/ledger", "doc_id long, verified boolean", "doc_id")
    ledger.append(t("labels").where("toxic = 0").select("doc_id", (F.col("quality") == 1).alias("verified")), batch="first")
    ledger.append(t("labels").select("doc_id", (F.col("toxic") == 1).alias("verified")), again=~F.col("verified"))
    ledger.append(t("labels").where("toxic = 0").select("doc_id", F.lit(False).alias("verified")), batch="first")  # come again: not entered
    ledger.compact()
    latest = stored(ledger.latest(), "latest")
    left = pending(t("documents").select("doc_id"), latest, "doc_id", "verified", retry=True).select("doc_id", F.lit(True).alias("_left"))
    both = t("documents").select("doc_id").join(latest, "doc_id", "left").join(left, "doc_id", "left")
    return both.select("doc_id", "verified", F.coalesce("_left", F.lit(False)).alias("pending"))


@query(
    """with d as (select doc_id, text, split_part(text, chr(10), 1) as one from documents)
select doc_id, one <> '' and doc_id % 3 <> 2 as ok, case when one <> '' and doc_id % 3 <> 2 then md5('second' || chr(10) || 'more' || substr(text, length(one) + 1)) end as digest,
  case when one = '' or doc_id % 3 = 2 then true else false end as failed from d"""
)
def replayed_edits(t):
    """Two or three edits of a document's first line, one after another; every third document's last one does not match."""
    rows = t("documents").select("doc_id", F.lit("m").alias("path"), "text")
    one = F.substring_index("text", "\n", 1)
    head = "--- a/m\n+++ b/m\n@@ -1 +1"
    first = F.when(one != "", F.concat(F.lit(f"{head} @@\n-"), one, F.lit("\n+first"))).otherwise(F.lit(f"{head} @@\n-no such line\n+x"))
    edits = F.array(first, F.lit(f"{head},2 @@\n-first\n+second\n+more"), F.when(F.col("doc_id") % 3 == 2, F.lit(f"{head} @@\n-first\n+again")))
    diffs = rows.select("doc_id", F.posexplode(F.filter(edits, lambda e: e.isNotNull())).alias("at", "diff"))
    out = runs.apply_to_tree(rows, diffs.repartition(F.xxhash64("at")), "doc_id", order="at")
    return out.select("doc_id", "ok", F.md5("text").alias("digest"), F.col("error").isNotNull().alias("failed"))


@query()
def token_labels(t):
    """Transcripts under a byte-level BPE and a template of turns: ids, supervised ids, and the ends of messages."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    rows = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    out = rows.withColumn("e", tokenized.encode_transcripts("messages", ranks, public_tokenizers.PATTERN))
    return out.select("conv_id", F.size("e.input_ids").alias("n"), labels.supervised(F.col("e.labels")).alias("supervised"), F.to_json("e.ends").alias("ends"))
