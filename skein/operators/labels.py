"""Transcripts to token ids and labels: rendering, masks, slices, padding, fitting.

A transcript is array<struct<role, content, train>>; a null `train` counts as true.  The template here is concatenative and
deterministic (one id a character of <role>content</role>); the operators take any array of ids per message.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASKED = -100
MESSAGES = "array<struct<role:string,content:string,train:boolean>>"
FITTED = f"struct<messages:{MESSAGES},dropped_turns:int,shrunk_messages:int,hard_truncated:int>"


def rendered(m: Column) -> Column:
    return F.concat(F.lit("<"), m["role"], F.lit(">"), F.coalesce(m["content"], F.lit("")), F.lit("</"), m["role"], F.lit(">"))


def char_ids(text: Column) -> Column:
    """One id a character."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) % 30000 + 2)


def trains(m: Column) -> Column:
    return (m["role"] == "assistant") & F.coalesce(m["train"], F.lit(True))


def without_flags(messages: Column, *names: str) -> Column:
    """Messages as a template may see them, without bookkeeping fields ('train' unless others are named)."""
    return F.transform(messages, lambda m: m.dropFields(*(names or ("train",))))


def encoded(messages: Column) -> Column:
    """struct<input_ids, labels>: ids of the whole transcript; labels are ids where a message is trained on, else -100.

    If nothing is, the last token is.
    """
    ids = F.transform(messages, lambda m: F.struct(char_ids(rendered(m)).alias("ids"), trains(m).alias("train")))
    flat = F.flatten(F.transform(ids, lambda x: x["ids"]))
    labels = F.flatten(F.transform(ids, lambda x: F.when(x["train"], x["ids"]).otherwise(F.transform(x["ids"], lambda _: F.lit(MASKED)))))
    last = F.concat(F.transform(F.slice(flat, 1, F.size(flat) - 1), lambda _: F.lit(MASKED)), F.slice(flat, -1, 1))
    return F.struct(flat.alias("input_ids"), F.when(F.exists(labels, lambda x: x != MASKED) | (F.size(flat) == 0), labels).otherwise(last).alias("labels"))


def sliced(labels: Column) -> Column:
    """struct<keep, targets>: rows of logits that predict a supervised label, and those labels."""
    at = F.filter(F.transform(labels, lambda x, i: F.struct((i - 1).alias("i"), x.alias("x"))), lambda s: (s["x"] != MASKED) & (s["i"] >= 0))
    return F.struct(F.transform(at, lambda s: s["i"]).alias("keep"), F.transform(at, lambda s: s["x"]).alias("targets"))


def supervised(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != MASKED))


def supervised_stats(rows: DataFrame, labels: str) -> DataFrame:
    """One row: number of transcripts, least, upper median and most supervised tokens."""
    n = rows.select(supervised(F.col(labels)).alias("n"))
    hist = n.groupBy("n").agg(F.count("*").alias("c"))
    ranked = hist.withColumns({"_to": F.sum("c").over(Window.orderBy("n")), "_all": F.sum("c").over(Window.partitionBy())})  # one row a distinct length
    return ranked.agg(F.max("_all").alias("n"), F.min("n").alias("least"), F.min(F.when(F.col("_to") > F.floor(F.col("_all") / 2), F.col("n"))).alias("p50"), F.max("n").alias("most"))


def padded(rows: DataFrame, batch: str, pad_id: int, multiple: int = 8) -> DataFrame:
    """input_ids, labels and attention of every row, as long as its batch's longest rounded up to a multiple."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    width = (F.ceil(longest / multiple) * multiple).cast("int")
    pad = lambda value, n: F.array_repeat(F.lit(value), n)
    rows = rows.withColumn("_pad", width - F.size("input_ids"))
    return rows.withColumns({
        "attention": F.concat(pad(1, F.size("input_ids")), pad(0, F.col("_pad"))),
        "labels": F.concat("labels", pad(MASKED, F.col("_pad"))),
        "input_ids": F.concat("input_ids", pad(pad_id, F.col("_pad"))),
    }).drop("_pad")


def batch_slices(rows: DataFrame, batch: str) -> DataFrame:
    """logits_to_keep, the sorted union of a batch's supervised rows, and each row's shift_labels over it."""
    keep = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_keep"))))
    union = rows.select(batch, sliced(F.col("labels"))["keep"].alias("_keep")).groupBy(batch).agg(keep.alias("logits_to_keep"))
    # the row of logits p predicts the label after it
    return rows.join(union, batch).withColumn("shift_labels", F.transform("logits_to_keep", lambda p: F.coalesce(F.get("labels", p + 1), F.lit(MASKED))))


def length(messages: list[dict]) -> int:
    return sum(len(m["role"]) * 2 + 5 + len(m["content"] or "") for m in messages)


def cut_middle(text: str) -> str:
    """Half of a text, at least 200 characters, as its two ends with a note between."""
    size = max(200, int(len(text) * 0.5))
    if len(text) <= size:
        return text
    head = int(size * 0.65 / 0.8)
    return f"{text[:head]}\n...[{len(text) - size} chars truncated]...\n{text[head - size:]}"


def fitted(messages: list[dict], budget: int, floor: int = 3000) -> tuple[list[dict], int, int, int]:
    """(messages, dropped turns, shrunk messages, 1 if still too long): a transcript made to fit a budget of ids.

    First long observations lose their middles, then the oldest turns go (never the head up to the first user message, nor
    the last turn), then shorter observations lose their middles too.
    """
    out, dropped, shrunk = [dict(m) for m in messages], 0, 0

    def shrink(least: int, n: int) -> int:
        """Cut the longest observation but the last message, the later of equals, up to 16 times while it does not fit."""
        for _ in range(16):
            long = [(len(m["content"] or ""), i) for i, m in enumerate(out[:-1]) if m["role"] in ("tool", "user") and len(m["content"] or "") > least]
            if length(out) <= budget or not long:
                break
            m = out[max(long)[1]]
            m["content"] = cut_middle(m["content"])
            n += 1
        return n

    shrunk = shrink(floor, shrunk)
    if length(out) > budget:
        head = next((i for i, m in enumerate(out) if m["role"] == "user"), 0) + 1
        turns = [i for i in range(head, len(out)) if out[i]["role"] == "assistant"]
        if turns:
            start = next((i for i in turns if length(out[:head]) + length(out[i:]) <= budget), turns[-1])
            if start > head:
                dropped = turns.index(start)
                out = out[:head] + out[start:]
        shrunk = shrink(200, shrunk)
    return out, dropped, shrunk, int(length(out) > budget)


def fit(messages, budget: int) -> Column:
    """struct<messages, dropped_turns, shrunk_messages, hard_truncated>; the phases depend on one another, so a pandas UDF."""
    names = ["messages", "dropped_turns", "shrunk_messages", "hard_truncated"]
    return F.pandas_udf(lambda s: pd.DataFrame([fitted(list(m), budget) for m in s], columns=names), FITTED)(messages)


def chosen_steps(n: Column, limit: int, seed: Column) -> Column:
    """Indexes of the steps to train on, ascending: always the last, others by a seeded hash."""
    every = F.sequence(F.lit(0), n - 1)
    ranked = F.array_sort(F.transform(F.slice(every, 1, n - 1), lambda i: F.struct(F.xxhash64(seed, i).alias("h"), i.alias("i"))))
    some = F.array_sort(F.concat(F.transform(F.slice(ranked, 1, limit - 1), lambda s: s["i"]), F.array(n - 1)))
    return F.when((n <= limit) | F.lit(limit <= 0), every).otherwise(some)


def shuffled_steps(n: Column, limit: int, seed: Column) -> Column:
    """chosen_steps by the Mersenne Twister of Python's random with an integer seed, as a published run drew them.

    The steps before the last are shuffled, and the first limit - 1 of them go with the last one.
    """

    def draw(size, start) -> list[int]:
        if limit <= 0 or size <= limit:
            return list(range(size))
        others = list(range(size - 1))
        random.Random(int(start)).shuffle(others)
        return sorted([*others[: limit - 1], size - 1])

    return F.pandas_udf(lambda a, b: pd.Series([draw(int(x), y) for x, y in zip(a, b)]), "array<int>")(n, seed)


def step_sample(prompt: list[dict], completion: list[int], max_len: int) -> tuple[list[int], list[int]]:
    """(input_ids, labels) of one step: a prompt fitted to what the completion leaves, its head kept at the last resort."""
    completion = completion[: max(1, max_len // 2)]
    messages = fitted(prompt, max(max_len - len(completion) - 16, 64))[0]
    ids = [ord(c) % 30000 + 2 for m in messages for c in f"<{m['role']}>{m['content'] or ''}</{m['role']}>"]
    ids = ids[: max(0, max_len - len(completion))] if len(ids) + len(completion) > max_len else ids
    return ids + completion, [MASKED] * len(ids) + completion


def step_samples(prompt, completion, max_len: int) -> Column:
    def one(p, c):
        return step_sample(list(p), [int(x) for x in c], max_len)

    kind = "struct<input_ids:array<int>,labels:array<int>>"
    return F.pandas_udf(lambda p, c: pd.DataFrame([one(x, y) for x, y in zip(p, c)], columns=["input_ids", "labels"]), kind)(prompt, completion)


def usable(messages: Column, max_chars: int = 0, min_messages: int = 2, with_calls: bool = False) -> Column:
    """Transcripts of enough messages and, with max_chars, few enough characters.

    with_calls: messages have tool_calls, whose arguments count as characters.
    """

    def size(m: Column) -> Column:
        own = F.length(F.coalesce(m["content"], F.lit("")))
        if not with_calls:
            return own
        calls = F.filter(F.coalesce(m["tool_calls"]["function"]["arguments"], F.array().cast("array<string>")), lambda a: a.isNotNull())
        return own + F.aggregate(calls, F.lit(0), lambda n, a: n + F.length(a))

    chars = F.aggregate(messages, F.lit(0), lambda n, m: n + size(m))
    return (F.size(messages) >= min_messages) & ((chars <= max_chars) if max_chars else F.lit(True))
