"""Queries of search and augmentation over the driver's tables, with the same in SQL.

documents are a history: a source is a repository, doc_id its commit, and the document the new content of one of a few paths;
one of under 60 characters deletes its path.  Every document is also a request at its own commit, and a task whose issue
names some of its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import augment, trigrams
from ..operators.history import History
from ..stored import stored
from .catalog import query

#: expressions with trigrams to look up, with alternatives, and without any
PATTERNS = ["th(e|at) [a-z]+ing", "[A-Z][a-z]*(heit|keit)", "er(tion|ing)[,.]$", "^(Que|Und) ", "l[ae]s? .*eur", "[0-9]{4}", "q.e", "(ion ?){2}"]
PATH = "lang || '/' || (doc_id % 5) || '.txt'"
LINE_LIST = "(case when text = '' then [] when ends_with(text, chr(10)) then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end)"

SPANS = f"""c as (select source as repo, {PATH} as path, doc_id as seq, case when length(text) >= 60 then text end as text from documents),
spans as (select *, lead(seq) over (partition by repo, path order by seq) as until from c),
held as (select repo, path, seq as since, until, text, unnest({LINE_LIST}) as line, generate_subscripts({LINE_LIST}, 1) as line_no from spans where text is not null),
"""
HITS = """all_hits as (select r.req, h.path, h.line_no, h.line, octet_length(encode(h.text)) <= 1000000 as small from r join held h on h.repo = r.repo and h.since <= r.seq and (h.until is null or r.seq < h.until) and r.query <> '' and contains(h.line, r.query)),
counted as (select req, count(*) as n_hits from all_hits group by req),
page as (select * from (select req, path, line_no, path || ':' || line_no || ': ' || left(regexp_replace(line, '\\s+$', ''), 400) as said,
  row_number() over (partition by req order by string_split(path, '/'), line_no) as k from all_hits where small) where k <= 25),
shown as (select req, count(*) as n_lines, string_agg(said, chr(10) order by k) || case when count(*) >= 25 then chr(10) || '... results truncated' else '' end as text from page group by req),
"""


def _history(t) -> DataFrame:
    path = F.concat("lang", F.lit("/"), (F.col("doc_id") % 5).cast("string"), F.lit(".txt"))
    return t("documents").select(F.col("source").alias("repo"), path.alias("path"), F.col("doc_id").alias("seq"), F.when(F.length("text") >= 60, F.col("text")).alias("text"))


def _patterns(t) -> DataFrame:
    return t("region").limit(1).select(F.explode(F.array(*[F.lit(p) for p in PATTERNS])).alias("query"), F.lit(True).alias("regex"))


@query(
    f"""with l as (select doc_id, unnest({LINE_LIST}) as line, generate_subscripts({LINE_LIST}, 1) as line_no from documents)
select p.pattern, doc_id, line_no::bigint as line_no from l, (values {", ".join(f"('{p}')" for p in PATTERNS)}) p(pattern) where regexp_matches(line, p.pattern)"""
)
def regex_lines(t):
    found = trigrams.matching_lines(t("documents").select("doc_id", "text"), _patterns(t), ["doc_id"], "text", "query", "regex")
    return found.select(F.col("query").alias("pattern"), "doc_id", "line_no")


PHRASE = r"^[^ \n]+ ([^ \n]+ [^ \n]+)"


@query(
    rf"""with {SPANS} r as (select doc_id as req, source as repo, doc_id as seq, regexp_extract(text, '{PHRASE}', 1) as query from documents),
{HITS} z as (select 1)
select r.req as doc_id, coalesce(n_hits, 0) as n_hits, coalesce(n_lines, 0) as n_lines, coalesce(n_lines, 0) >= 25 as truncated, coalesce(text, 'no matches for ''' || query || '''') as text
from r left join counted using (req) left join shown using (req)"""
)
def searched_history(t):
    requests = t("documents").select(F.col("doc_id").alias("req"), F.col("source").alias("repo"), F.col("doc_id").alias("seq"), F.regexp_extract("text", PHRASE, 1).alias("query"))
    history = History(_history(t), stored)
    hits = stored(history.hits(requests), "hits")
    out = history.search(history.counted(requests, hits), hits=hits)
    return out.select(F.col("req").alias("doc_id"), "n_hits", F.col("n_lines").cast("long").alias("n_lines"), "truncated", "text")


def _records(t) -> DataFrame:
    """A task a document: it reads its own file and the next one of its repository, edits, tests, submits."""
    path = F.concat("lang", F.lit("/"), (F.col("doc_id") % 5).cast("string"), F.lit(".txt"))
    other = F.concat("lang", F.lit("/"), ((F.col("doc_id") + 1) % 5).cast("string"), F.lit(".txt"))
    words = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{5,}"), F.lit(0)), 1, 4)
    issue = F.concat(F.lit("See "), F.array_join(F.transform(words, lambda w: F.concat(F.lit("`"), w, F.lit("`"))), " and "))
    call = lambda name, arguments: F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"), F.array(F.struct(F.struct(F.lit(name).alias("name"), arguments.alias("arguments")).alias("function"))).alias("tool_calls"))
    seen = lambda text: F.struct(F.lit("tool").alias("role"), text.alias("content"), F.lit(None).cast("array<struct<function: struct<name: string, arguments: string>>>").alias("tool_calls"))
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"), F.lit(None).cast("array<struct<function: struct<name: string, arguments: string>>>").alias("tool_calls"))
    arguments = lambda p: F.to_json(F.struct(p.alias("path")))
    edit = F.to_json(F.struct(path.alias("path"), F.lit("@@ -1,2 +1,2 @@\n-a\n+b\n+c\n").alias("diff")))
    status = F.when(F.col("text").contains("x"), "status=pass").otherwise("status=fail")
    messages = F.array(
        said("system", F.lit("You fix it.")), said("user", F.col("issue")), call("read_file", arguments(path)), seen(F.lit("1: a")), call("read_file", arguments(other)),
        seen(F.lit("1: b")), call("edit_file", edit), seen(F.lit("ok")), call("run_tests", F.lit("{}")), seen(F.col("status")), call("submit", F.lit("{}")), seen(F.lit("done")),
    )
    rows = t("documents").select("doc_id", "source", "lang", issue.alias("issue"), status.alias("status"))
    records = rows.select(F.col("doc_id").alias("task_id"), F.col("source").alias("repo"), F.col("doc_id").alias("seq"), "issue", F.lit("").alias("diff"), messages.alias("messages"))
    return stored(records, "records")  # a task's table, which several plans read: made of the texts once


PLAN = f"""{SPANS}
w as (select doc_id, source as repo, doc_id as seq, unnest(regexp_extract_all(text, '[A-Za-z]{{5,}}')[:4]) as query, generate_subscripts(regexp_extract_all(text, '[A-Za-z]{{5,}}')[:4], 1) as i from documents),
u as (select doc_id, repo, seq, query, min(i) as rank from w where length(query) <= 60 and lower(query) not in (STOPS) group by 1, 2, 3, 4),
r as (select doc_id || '/' || rank as req, * from u),
{HITS}
usable as (select r.doc_id, r.query, r.rank, s.n_lines, s.text, (select count(distinct path) from page p where p.req = r.req) as n_files, r.req
  from r join counted c on c.req = r.req join shown s on s.req = r.req where c.n_hits <= 400 and s.n_lines < 25),
reads as (select doc_id, lang || '/' || ((doc_id + 1) % 5) || '.txt' as path, 1 as pos from documents union all select doc_id, {PATH}, 0 from documents),
lists as (select req, path, min(line_no) as line from page group by req, path),
o as (select u.*, d.path, d.pos, l.line from usable u join reads d on d.doc_id = u.doc_id join lists l on l.req = u.req and l.path = d.path),
b as (select *, row_number() over (partition by doc_id, path order by n_lines, rank) = 1 as best, min(n_lines) over (partition by doc_id, path) as least, min(pos) over (partition by doc_id) as pos0 from o),
g as (select *, n_lines >= 8 and n_lines > least and pos = 0 and ('0x' || substr(sha256(doc_id::varchar), 1, 2))::int / 255.0 < 0.25 as broad from b where pos0 = 0),
h as (select *, row_number() over (partition by doc_id, path order by broad desc, n_lines desc, rank) = 1 as first_broad from g),
s as (select *, row_number() over (partition by doc_id order by pos, best) as k from h where best or (broad and first_broad))"""


def _plan_sql() -> str:
    from ..operators.search import STOP_WORDS

    return PLAN.replace("STOPS", ", ".join(f"'{w}'" for w in STOP_WORDS))


@query(f"with {_plan_sql()} select doc_id, k::int as k, query, n_lines::int as n_lines, n_files::int as n_files from s")
def planned_searches(t):
    records = _records(t)
    reads = augment.reads_of(augment.steps_of(records))
    plan = augment.plan_searches(records.select("task_id", "repo", "seq", "issue", "diff"), reads, History(_history(t), stored))
    return plan.select(F.col("task_id").alias("doc_id"), "k", "query", "n_lines", "n_files")


@query(
    f"""with {_plan_sql()},
base as (select doc_id, step, name, args, content from (select doc_id, unnest([0, 1, 2, 3, 4]) as step, unnest(['read_file', 'read_file', 'edit_file', 'run_tests', 'submit']) as name,
  unnest(['{{"path":"' || {PATH} || '"}}', '{{"path":"' || lang || '/' || ((doc_id + 1) % 5) || '.txt"}}', '{{"path":"' || {PATH} || '","diff":"@@ -1,2 +1,2 @@\\n-a\\n+b\\n+c\\n"}}', '{{}}', '{{}}']) as args,
  unnest(['1: a', '1: b', 'ok', case when contains(text, 'x') then 'status=pass' else 'status=fail' end, 'done']) as content from documents) where doc_id in (select doc_id from s)),
shows as (select s.doc_id, s.k, l.path, l.line from s join lists l on l.req = s.req),
n as (select doc_id, max(k) as n from s group by doc_id),
need as (select d.doc_id, d.pos, d.path, coalesce((select min(k) from shows x where x.doc_id = d.doc_id and x.path = d.path), n.n) as p from reads d join n on n.doc_id = d.doc_id),
after as (select doc_id, pos, path, max(p) over (partition by doc_id order by pos) as p, lag(p, 1, 0) over (partition by doc_id order by pos) as q from need),
put as (select a.doc_id, a.pos as step, s.k, s.query, s.text, lag(s.n_lines) over (partition by s.doc_id order by s.k) as ln, lag(s.n_files) over (partition by s.doc_id order by s.k) as lf from s
  join after a on a.doc_id = s.doc_id and a.q < s.k and s.k <= a.p),
m as (select b.doc_id, b.step, 1000000 as k, name, args, content, case name when 'read_file' then 'The search matched `' || a.path || '`' ||
    coalesce(' (line ' || (select line from shows x where x.doc_id = b.doc_id and x.k = a.p and x.path = a.path) || ')', '') || '. Reading the file to understand the code around the match.'
  when 'edit_file' then 'Making a minimal change to `' || c.path || '` (+2/-1 lines) to address the issue.' when 'run_tests' then 'Running the task''s tests to verify the change.'
  else case when exists (select 1 from base y where y.doc_id = b.doc_id and y.content = 'status=pass') then 'The tests pass, so I''m submitting the patch.' else 'Submitting the patch.' end end as note
  from base b left join after a on a.doc_id = b.doc_id and a.pos = b.step and name = 'read_file' left join reads c on c.doc_id = b.doc_id and c.pos = 0
  union all select doc_id, step, k, 'search_repo', '{{"query":"' || query || '"}}', text,
  case when ln is null then 'The issue mentions `' || query || '`. I''ll search the repo to find where it is defined or used.'
  else 'The previous search matched ' || ln || ' lines in ' || lf || ' files, which is too broad. Narrowing down with `' || query || '`.' end from put)
select doc_id, 'ok' as status, (row_number() over (partition by doc_id order by step, k) - 1)::int as call, name, args as arguments, md5(content) as content, note from m
union all select doc_id, 'no_discoverable_query', null, null, null, null, null from documents where doc_id not in (select doc_id from s)"""
)
def augmented_transcripts(t):
    out = augment.augment(_records(t), History(_history(t), stored), leaks=("nobody-has-this",))
    pairs = F.filter("messages", lambda m: m["role"].isin("assistant", "tool"))
    rows = out.select("task_id", "status", pairs.alias("m"))
    part = lambda i: F.get(F.col("m"), i)
    function = lambda i: F.get(part(2 * i)["tool_calls"], F.lit(0))["function"]
    answer = lambda i: F.when(part(2 * i + 1)["tool_call_id"] == F.format_string("call_%d", i), part(2 * i + 1)["content"])
    said = lambda i: F.struct(i.alias("call"), function(i)["name"].alias("name"), function(i)["arguments"].alias("arguments"), F.md5(answer(i)).alias("content"), part(2 * i)["content"].alias("note"))
    calls = F.when(F.size("m") > 1, F.transform(F.sequence(F.lit(0), F.floor(F.size("m") / 2).cast("int") - 1), said))
    return rows.select(F.col("task_id").alias("doc_id"), "status", F.explode_outer(calls).alias("c")).select("doc_id", "status", "c.*")
