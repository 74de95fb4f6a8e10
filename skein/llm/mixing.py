"""Operator 8, mixing sources to target weights: certain whole copies, then Pareto order sampling for the rest.

A source's target t over its size s gives every document t/s copies on average, in proportion to `preference` if one
is given.  The whole part is certain; the fraction p is an inclusion probability.  Documents are ranked by
(u / (1-u)) / (p / (1-p)), u a uniform number hashed from seed, id and text, and taken in that order until the words
reach what the certain copies leave of the target.

The cut is found without sorting a source in one task: ranks are summed in 2^12 bins per source, the bin that holds
the cut is split into 2^12 again, and only the documents of the last bin are ordered.
Nulls: a null source is a source of its own, last in order; a null text or one without words has size 0 and is taken 0
times; a null id is hashed as an empty string.  Exact repeats of a row draw the same u and are ordered arbitrarily,
which leaves the result unchanged as a bag.  Other columns stay; taken, size, source_size and target replace
columns of these names.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, materialise

BINS = 4096


def _text_key(text):
    """32 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], max_copies: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source: water filling in closed form.

    Sources in code-point order, null last, take the weights in turn; a target stops at max_copies times the source's
    size and the excess goes to the others by weight.  One window over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    out = sizes.select("source", "source_size").withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(max_copies)))
    out = out.withColumn("_r", F.col("_cap") / F.col("_w"))
    everything = Window.partitionBy()
    below = Window.orderBy("_r", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns(
        {
            "_total": F.sum("source_size").over(everything).cast("double"),
            "_weights": F.sum("_w").over(everything),
            "_caps": F.coalesce(F.sum("_cap").over(below), F.lit(0.0)),
            "_used": F.coalesce(F.sum("_w").over(below), F.lit(0.0)),
        }
    )
    # the level if exactly the sources below are at their caps; the water level is the first that fits under the row
    out = out.withColumn("_level", (F.col("_total") - F.col("_caps")) / (F.col("_weights") - F.col("_used")))
    level = F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", "_level"))).over(everything)["_level"]
    out = out.withColumn("_at", F.coalesce(level, F.max("_r").over(everything)))
    return out.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * F.col("_at")).alias("target"))


def _small(df):
    """One or a few rows a source: broadcast while there are at most 100,000, shuffled beyond."""
    return broadcast_if_small(df, 100_000)


def _by_source(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    return rows.join(_small(table.withColumnRenamed("source", "s2")), F.col("source").eqNullSafe(F.col("s2")), how).drop("s2")


def _draws(docs: DataFrame, seed: int, preference: str | None, id_col: str, text_col: str, source_col: str, *keep) -> DataFrame:
    """id, source, size, _key (hash of the text), _pref and the uniform number _u of every row, after the columns to keep."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("_key").cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    light = docs.select(
        *keep,
        F.col(id_col),
        F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        _text_key(F.col(text_col)).alias("_key"),
        (F.col(preference).cast("double") if preference else F.lit(1.0)).alias("_pref"),
    )
    return light.withColumn("_u", u)


def _ranked(light: DataFrame, per_source: DataFrame, max_copies: int, even: bool) -> DataFrame:
    """The certain copies _whole, the rank _q of the rest and its bins _b1 and _b2."""
    rows = _by_source(light, per_source)
    mean = F.least(F.lit(float(max_copies)), F.col("_pref") * F.col("target") / F.col("_prefs"))
    rows = rows.withColumn("_mean", F.when(F.col("size") > 0, mean).otherwise(0.0))
    rows = rows.withColumn("_whole", F.floor("_mean")).withColumn("_p", F.col("_mean") - F.col("_whole"))
    q = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    # q / (1 + q) has the order of q and lies in (0, 1); where a source's p is one number u has the same order, and fills
    # the bins evenly whatever that number is
    rows = rows.withColumn("_q", F.when(F.col("_p") > 0, F.col("_u") if even else q / (1 + q)))
    rows = rows.withColumn("_b1", F.floor(F.col("_q") * BINS)).withColumn("_b2", F.floor(F.col("_q") * BINS * BINS) % BINS)
    return rows


def _cuts(light: DataFrame, weights: list[int], max_copies: int, even: bool) -> tuple[DataFrame, DataFrame]:
    """One row a source each: sizes and targets; what is needed beyond the certain copies and the bins of the cut."""
    per_source = light.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_pref")).alias("_prefs")
    )
    targets = source_targets(per_source.select("source", "source_size"), weights, max_copies)
    per_source = materialise(
        per_source.select(F.col("source").alias("s2"), "_prefs").join(targets, F.col("s2").eqNullSafe(F.col("source"))).drop("s2"), "mix-targets"
    )
    rows = _ranked(light, per_source, max_copies, even)

    def cut(binned: DataFrame, bin_col: str, need_col: str) -> DataFrame:
        """The bin of each source in which the running sum passes what is needed; one row a source."""
        w = Window.partitionBy("source").orderBy(bin_col)
        run = binned.withColumn("_after", F.sum("_words").over(w)).withColumn("_before", F.col("_after") - F.col("_words"))
        return run.where(F.col("_after") >= F.col(need_col)).groupBy("source").agg(
            F.min(F.struct(F.col(bin_col).alias("b"), F.col("_before").alias("before"))).alias("_c")
        )

    need = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("_whole"))).alias("_need"))
    need = materialise(need, "mix-need")
    bins = rows.where("_q is not null").groupBy("source", "_b1").agg(F.sum("size").alias("_words"))
    bins = _by_source(bins, need)
    first = cut(bins, "_b1", "_need").select("source", F.col("_c.b").alias("_cut1"), F.col("_c.before").alias("_before1"))
    first = materialise(_by_source(need, materialise(first, "mix-cut1"), "left"), "mix-first")
    fine = _by_source(rows, first).where("_b1 = _cut1")
    bins = fine.groupBy("source", "_b2").agg(F.sum("size").alias("_words"), F.first(F.col("_need") - F.col("_before1")).alias("_left"))
    second = cut(bins, "_b2", "_left").select("source", F.col("_c.b").alias("_cut2"), F.col("_c.before").alias("_before2"))
    cuts = materialise(_by_source(first, materialise(second, "mix-cut2"), "left"), "mix-cuts")
    return per_source, cuts


def _decided(light: DataFrame, per_source: DataFrame, cuts: DataFrame, max_copies: int, even: bool) -> DataFrame:
    """_last: the row lies in the bin of the cut; _extra: 1 for rows of the bins before."""
    rows = _by_source(_ranked(light, per_source, max_copies, even), cuts, "left")
    last = F.col("_q").isNotNull() & F.col("_b1").eqNullSafe(F.col("_cut1")) & F.col("_b2").eqNullSafe(F.col("_cut2"))
    inside = F.col("_q").isNotNull() & (F.col("_need") > 0) & (
        F.col("_cut1").isNull() | (F.col("_b1") < F.col("_cut1")) | ((F.col("_b1") == F.col("_cut1")) & (F.col("_cut2").isNull() | (F.col("_b2") < F.col("_cut2"))))
    )
    return rows.withColumn("_last", last).withColumn("_extra", inside.cast("long"))


def _edge(rows: DataFrame, id_col: str) -> DataFrame:
    """Documents of the last bin, some 1 / 2^24 of a source, in order; one is taken if that brings the sum nearer."""
    order = Window.partitionBy("source").orderBy("_q", id_col, "_key").rowsBetween(Window.unboundedPreceding, -1)
    run = F.col("_before1") + F.col("_before2") + F.coalesce(F.sum("size").over(order), F.lit(0))
    edge = rows.where("_last").withColumn("_run", run)
    return edge.withColumn("_extra", (F.col("_run") + F.col("size") / 2 <= F.col("_need")).cast("long")).drop("_run")


def plan_mix(
    docs: DataFrame,
    weights: list[int] | None = None,
    max_copies: int = 3,
    seed: int = 8,
    preference: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One light row a document: id, _key (hash of the text), source, size, source_size, target, copies, taken.

    preference: a column of positive numbers; a document's expected copies are in proportion to it inside its source,
    at most max_copies each (the source's total may then stay below its target).
    """
    light = materialise(_draws(docs, seed, preference, id_col, text_col, source_col), "mix-sizes")
    even = preference is None
    rows = _decided(light, *_cuts(light, weights or [1, 2, 3], max_copies, even), max_copies, even)
    out = _edge(rows, id_col).unionByName(rows.where(~F.col("_last")))
    copies = (F.col("_whole") + F.col("_extra")).cast("long")
    return out.select(
        F.col(id_col), F.col("_key"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mix(
    docs: DataFrame,
    weights: list[int] | None = None,
    max_copies: int = 3,
    seed: int = 8,
    preference: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """docs with every row as often as the mix takes it, its columns unchanged: the copies of plan_mix.

    Every row is decided where it lies, from its own draw and its source's cut, so texts are not shuffled; only the
    rows of the last bin look their turn up.  Where the cut falls among equal repeats of a row, at most one group of
    them a source, these are numbered to take as many as the plan does.
    """
    draw, even = (seed, preference, id_col, text_col, source_col), preference is None
    light = materialise(_draws(docs, *draw), "mix-sizes")
    per_source, cuts = _cuts(light, weights or [1, 2, 3], max_copies, even)
    edge = _edge(_decided(light, per_source, cuts, max_copies, even), id_col)
    edge = edge.groupBy(F.col(id_col).alias("_id"), F.col("_key").alias("_k2"), F.col("source").alias("_s2")).agg(
        F.sum("_extra").alias("_turns"), F.count("*").alias("_alike")
    )
    edge = materialise(edge, "mix-edge")
    rows = _decided(_draws(docs, *draw, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")), per_source, cuts, max_copies, even)
    same = F.col("_last") & F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k2")) & F.col("source").eqNullSafe(F.col("_s2"))
    rows = rows.join(_small(edge), same, "left")
    cut = F.col("_last") & (F.col("_turns") > 0) & (F.col("_turns") < F.col("_alike"))
    cut = F.coalesce(cut, F.lit(False))
    repeats = Window.partitionBy(id_col, "_key", "source").orderBy(F.lit(0))
    sure = rows.where(~cut).withColumn("_n", F.col("_whole") + F.when(F.col("_last"), (F.col("_turns") > 0).cast("long")).otherwise(F.col("_extra")))
    split = rows.where(cut).withColumn("_n", F.col("_whole") + (F.row_number().over(repeats) <= F.col("_turns")).cast("long"))
    taken = sure.unionByName(split).where("_n > 0")
    return taken.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long")))).select("_doc.*")
