"""The operators as queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from . import bpe, decontam, html, jaccard, lines, mixing, quality, repair, substrings, tokens, trie, urlfilter, warc

#: The rules of op10, (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.jaccard_components(_table(spark, sf_dir, "documents"), size=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared", "n_vetoed", "n_marked")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1, keep_first=False)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan_mix(_table(spark, sf_dir, "documents"), weights=[1, 2, 3], max_copies=3)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.substring_dedup(_table(spark, sf_dir, "documents"), min_words=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = urlfilter.url_verdicts(_table(spark, sf_dir, "pages"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(id, turns) of op11: the first h turns of conversation c - c % 20, then what c has after its own first h; h = crc32(c) % 4."""
    keyed = trie.turn_keys(conversations).withColumn("base", F.expr("id - id % 20"))
    turns = trie.ordered_turns(keyed.repartition("base"), "base")  # at most 20 conversations a base, so all of them fit a window
    h = (F.crc32(F.col("id").cast("string")) % 4).cast("int")
    begin = F.max(F.when(F.col("id") == F.col("base"), F.slice("turns", 1, 3))).over(Window.partitionBy("base"))
    turns = turns.select("id", "turns", h.alias("h"), begin.alias("begin"))
    none = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return turns.select("id", F.concat(F.coalesce(F.slice("begin", F.lit(1), F.col("h")), none), own).alias("turns"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie.trie(trie.sequences(rebuilt(_table(spark, sf_dir, "conversations"))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of op12: by crc32(conv_id:turn) % 20 dropped (role and text null), emptied, without stops, repeated, made a user's."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").when(F.col("kind") != 0, F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("kind") != 0, F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair.repair(damaged(_table(spark, sf_dir, "conversations")))
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.select(F.col("id").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text, 256).alias("repaired_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text"), ranks)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_token_output": op2_token_output,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_html_extraction": op4_html_extraction,
        "op5_warc": op5_warc,
        "op6_quality_rules": op6_quality_rules,
        "op7_line_dedup": op7_line_dedup,
        "op8_mixing": op8_mixing,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_url_filters": op10_url_filters,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_structure_repair": op12_structure_repair,
        "op13_byte_bpe": op13_byte_bpe,
        "pipeline": pipeline,
    }


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _count(pattern: str, text: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _quality_sql() -> str:
    words, phrase = _count(r"[^\x20\x09-\x0D]+", "line"), "|".join(quality.BOILERPLATE).replace("'", "''")
    bad = f"""(({_count("[|»›·•]", "line")} >= 3 and {_count("[|»›·•]", "line")} >= {words} * 0.25)
      or ({_count("[#*$%&<>{}]+", "line")} >= 2 and {_count("[#*$%&<>{}]+", "line")} >= {words} * 0.5)
      or (regexp_matches(lower(line), '{phrase}') and {words} <= 30)
      or ({words} >= 12 and not regexp_matches(line, '[^\\x20\\x09-\\x0D][.!?…:;,。！？؟।](?:["''”’»)\\]]*)(?:[\\x20\\x09-\\x0D]|$)')))"""
    return f"""
with d as (select doc_id, coalesce(text, '') as text, {WORDS} as ws from documents),
l as (select doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
lines as (select doc_id, count(*) - count(distinct line) as n_dup_lines,
  sum(case when {bad} then 0 else length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) end) as kept_chars from l group by doc_id),
win as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from d)),
rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, k) as c from win) where c > 1),
cov as (select doc_id, count(distinct i + j) as n from rep, range(0, 5) t(j) group by doc_id),
m as (select d.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, {_count("[#*$%&|<>]", "text")}::bigint as n_symbols,
  coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, coalesce(kept_chars, 0) as kept_chars
  from d left join lines using (doc_id) left join cov using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * kept_chars >= 50 * word_chars as kept from b"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, a bit at a time."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_transform(range(8), lambda k: ((ascii(c) >> k::int) & 1)::bigint)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda a, b: xor(a >> 1, 3988292384::bigint * (xor(a, b) & 1))), 4294967295::bigint)"


def _trie_sql() -> str:
    return f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
k as (select conv_id, md5(length(role) || ':' || role || text) as k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w, turn from t),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, k) as i from k),
c as (select conv_id, conv_id - conv_id % 20 as base, {_crc32_sql("conv_id::varchar")} % 4 as h from (select distinct conv_id from t)),
r as (select c.conv_id, o.i, k, w from c join o on o.conv_id = c.base and o.i <= h union all select c.conv_id, o.i, k, w from c join o on o.conv_id = c.conv_id and o.i > h),
s as (select conv_id, list(k order by i) as ks, list(w order by i) as ws from r group by conv_id),
f as (select conv_id, coalesce(ks, []) as ks, coalesce(ws, []) as ws from c left join s using (conv_id)),
m as (select conv_id, d, md5(array_to_string(ks[1:d], ',')) as p, case when d > 0 then md5(array_to_string(ks[1:d - 1], ',')) end as up,
  case when d > 0 then ws[d] else 0 end as w, d = len(ks) as ends from (select *, unnest(range(len(ks) + 1)) as d from f)),
n as (select d, p, any_value(up) as up, min(conv_id) as conv_id, count(*) as n, any_value(w) as w, string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends) as e from m group by d, p),
x as (select n.*, (select count(*) from n y where y.d = n.d + 1 and y.up = n.p) as n_children from n),
u as (select distinct a.d, a.p, b.d as d2, b.p as p2 from m a join m b on a.conv_id = b.conv_id and b.d >= a.d),
v as (select u.d, u.p, sum((x.n - 1) * x.w) as saved, count(*) filter (where x.n_children = 0) as n_leaves from u join x on x.d = u.d2 and x.p = u.p2 group by u.d, u.p)
select x.conv_id, x.d::bigint as depth, y.conv_id as parent_conv_id, x.n as n_convs, x.n_children, v.n_leaves, v.saved::bigint as saved_tokens, sha256(coalesce(x.e, '')) as ends_sha256
from x join v on v.d = x.d and v.p = x.p left join n y on y.d = x.d - 1 and y.p = x.up"""


def _repair_sql() -> str:
    return f"""
with recursive a as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  {_crc32_sql("(conv_id || ':' || coalesce(turn::varchar, ' '))")} % 20 as kind from conversations where conv_id is not null),
b as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
  case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) from a where kind <> 0),
o as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as tail from b),
p as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again, lag(role[1]) over (partition by conv_id order by i) || role[1] as pair from o),
f as (select *, case when tail = '' then 'blank' when again then 'duplicate' when right(tail, 1) not in ('.', '!', '?') then 'truncated' end as fault from p),
q(prev, nxt, ins, put) as (values ('', 's', '', []::varchar[]), ('', 'u', '', []), ('s', 'u', '', []), ('a', 'u', '', []), ('u', 'u', 'I', ['assistant:']),
  ('', 'a', 'I', ['user:']), ('s', 'a', 'I', ['user:']), ('u', 'a', '', []), ('a', 'a', 'I', ['user:'])),
r as (select distinct conv_id, 0::bigint as i, '' as st, 0 as cost, '' as audit, []::varchar[] as rep from conversations where conv_id is not null
  union all
  select conv_id, i, st, cost, audit, rep from (
    select r.conv_id, f.i, r.st, r.cost + 3 as cost, r.audit || 'D' as audit, r.rep from r join f on f.conv_id = r.conv_id and f.i = r.i + 1
    union all
    select r.conv_id, f.i, q.nxt, r.cost + 2 * length(q.ins) + (case when f.role[1] = q.nxt then 0 else 2 end) + (case when f.fault = 'truncated' then 1 else 0 end),
      r.audit || q.ins || (case when f.role[1] = q.nxt then 'K' else 'R' end),
      r.rep || q.put || [(case when f.role[1] = q.nxt then f.role when q.nxt = 'u' then 'user' else 'assistant' end) || ':' || f.text]
    from r join f on f.conv_id = r.conv_id and f.i = r.i + 1 join q on q.prev = r.st
    where coalesce(f.fault, '') not in ('blank', 'duplicate') and (q.nxt <> 's' or f.role[1] = 's'))
  qualify row_number() over (partition by conv_id, st order by cost, audit) = 1),
g(st, more, put) as (values ('', '', []::varchar[]), ('a', '', []), ('u', 'I', ['assistant:']), ('s', 'II', ['user:', 'assistant:'])),
z as (select conv_id, max(i) as n from r group by conv_id),
e as (select r.conv_id, cost + 2 * length(more) as cost, audit || more as audit, rep || put as rep from r join z on z.conv_id = r.conv_id and z.n = r.i join g using (st)
  qualify row_number() over (partition by r.conv_id order by cost + 2 * length(more), audit || more) = 1),
h as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
  count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where i > 1 and coalesce(pair, '') not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cost::bigint as cost, audit, sha256(array_to_string(rep, chr(10))) as repaired_sha256 from e left join h using (conv_id)"""


def oracle_sql() -> dict[str, str]:
    hexed = "('0x' || substr(md5({}), 1, {}))::bigint"
    return {
        "op3_jaccard_join": f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
u as (select a, b from e union all select b, a from e),
r as (select doc_id as a, doc_id as b from w union select r.a, u.b from r join u on r.b = u.a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.b) as component_id from w join r on r.a = w.doc_id left join n on n.doc_id = w.doc_id group by 1, 2""",
        "op5_warc": """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) else page_id end as best from p)
select page_id, payload_bytes, payload_digest, case when page_id = best then 'response' else 'revisit' end as record_type,
case when page_id <> best then best end as refers_to from m""",
        "op6_quality_rules": _quality_sql(),
        "op7_line_dedup": f"""
with l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
k as (select *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') as key from l),
h as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines, count(h.key)::bigint as n_dropped,
sha256(coalesce(string_agg(line, chr(10) order by i) filter (where h.key is null), '')) as kept_sha256 from k left join h on k.key = h.key group by doc_id""",
        "op8_mixing": f"""
with d as (select doc_id, source, len({WORDS})::bigint as size,
  ({hexed.format("'8:' || coalesce(doc_id::varchar, '') || ':' || " + hexed.format("coalesce(text, '')", 8), 12)} + 0.5::double) / 281474976710656::double as u from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w, source_size * 3::double as cap from s),
r as (select *, cap / w as r from w),
v as (select *, (sum(source_size) over ())::double as total, sum(w) over () as ws,
  coalesce(sum(cap) over (order by r, source nulls last rows between unbounded preceding and 1 preceding), 0) as caps,
  coalesce(sum(w) over (order by r, source nulls last rows between unbounded preceding and 1 preceding), 0) as used from r),
t as (select source, source_size, least(cap, w * coalesce((select min(struct_pack(r := r, l := (total - caps) / (ws - used))) from v where (total - caps) / (ws - used) <= r).l, (select max(r) from v))) as target from v),
m as (select d.*, source_size, target, case when size > 0 then least(3::double, target / source_size) else 0 end as mean from d join t on d.source is not distinct from t.source),
p as (select *, floor(mean) as whole, mean - floor(mean) as p from m),
q as (select *, case when p > 0 then ((u / (1 - u)) / (p / (1 - p))) end as q0 from p),
n as (select *, q0 / (1 + q0) as q, target - sum(size * whole) over (partition by source) as need from q),
c as (select *, coalesce(sum(size) over (partition by source order by q nulls last, doc_id rows between unbounded preceding and 1 preceding), 0) as run from n)
select doc_id, size, source_size, target, ((whole + case when q is not null and run + size / 2.0::double <= need then 1 else 0 end) * size)::bigint as taken from c""",
        "op9_substring_dedup": f"""
with w as (select doc_id, {WORDS} as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w)),
dup as (select doc_id, i from (select *, row_number() over (partition by k order by doc_id, i) as rn from win) where rn > 1),
gone as (select distinct doc_id, i + j as p from dup, range(0, 20) t(j)),
x as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
y as (select x.doc_id, count(gone.p) as n_removed, string_agg(word, ' ' order by x.p) filter (where gone.p is null) as kept from x left join gone using (doc_id, p) group by x.doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join y using (doc_id)""",
        "op10_url_filters": f"""
with r(h, p, v) as (values {", ".join(str(x) for x in URL_RULES)}),
u as (select page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) as rest from pages),
x as (select page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from u),
b as (select x.*, r.h || r.p as rule, r.v, row_number() over (partition by page_id order by length(r.h || r.p) desc nulls last) as k
  from x left join r on (x.host = r.h or ends_with(x.host, '.' || r.h)) and starts_with(x.path, r.p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from b where k = 1""",
        "op11_conversation_trie": _trie_sql(),
        "op12_structure_repair": _repair_sql(),
    }
