"""Verification of tasks as expressions over recorded runs: test specs, labels, sets of outcomes, the verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import test_ids


def ordered(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def capped(a: Column, cap: int) -> Column:
    return F.slice(F.array_sort(a), 1, cap) if cap else a


def budgeted(items: Column, budget: int = 6000) -> Column:
    """The first items whose lengths, plus one each, stay within a budget."""
    total = F.aggregate(items, F.lit(0), lambda n, x: n + F.length(x) + 1)
    ends = F.transform(items, lambda _, i: F.aggregate(F.slice(items, F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.length(x) + 1))
    return F.when(total <= budget, items).otherwise(F.filter(items, lambda _, i: F.get(ends, i) <= budget))


def django_labels(entries: Column) -> Column:
    """module.Class.name of 'name (module.Class)' and 'name (module.Class.name)'; other entries go."""
    pattern = r"^(\w+) \(([\w.]+)\)$"

    def label(x: Column) -> Column:
        name, of = F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)
        return F.when(of.endswith(F.concat(F.lit("."), name)), of).otherwise(F.concat(of, F.lit("."), name))

    return F.transform(F.filter(entries, lambda x: x.rlike(pattern)), label)


def label_file(label: Column) -> Column:
    """The file of a label: its module's, less class and name."""
    parts = F.split(label, r"\.")
    module = F.when(F.size(parts) >= 3, F.slice(parts, F.lit(1), F.size(parts) - 2)).otherwise(F.slice(parts, 1, 1))
    return F.concat(F.lit("tests/"), F.array_join(module, "/"), F.lit(".py"))


def file_label(path: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "^tests/", ""), r"\.[^./]*$", "")
    return F.translate(bare, "/", ".")


def test_specs(runner: Column, f2p: Column, p2p: Column, files: Column, cap: int = 0) -> Column:
    """array<struct<runner, targets, k_expr>>: candidate specs, the most exact first; null specs are left out."""
    none = F.array().cast("array<string>")

    def spec(targets: Column, k: Column | None = None) -> Column:
        return F.struct(runner.alias("runner"), targets.alias("targets"), (F.lit("") if k is None else k).alias("k_expr"))

    labels = django_labels(f2p)
    exact = budgeted(ordered(labels))
    coarse = budgeted(ordered(F.transform(F.concat(F.transform(labels, label_file), files), file_label)))
    django = F.array(
        F.when(F.size(labels) > 0, spec(exact)),
        F.when((F.size(coarse) > 0) & ((F.size(labels) == 0) | (coarse != exact)), spec(coarse)),
        F.when((F.size(labels) == 0) & (F.size(coarse) == 0), spec(none)),
    )
    by_name = F.array(spec(files, F.array_join(budgeted(ordered(f2p), 5000), " or ")), F.when(F.size(files) > 0, spec(files)))
    nodes = budgeted(F.concat(ordered(f2p), F.array_sort(F.array_except(capped(p2p, cap), f2p))))
    own = budgeted(ordered(files))
    pytest = F.array(spec(nodes), F.when((F.size(own) > 0) & (own != nodes), spec(own)))
    return F.filter(F.when(runner == "django", django).when(runner == "pytest-k", by_name).otherwise(pytest), lambda s: s.isNotNull())


def flip(f2p: Column, pre: Column, post: Column, collection_broken: Column) -> Column:
    """struct<not_passing, broken, env_drift, flips> from the (passed, failed) sets of the runs before and after a patch.

    If collection broke before the patch, all fail-to-pass tests count as failed before.
    """
    failed_pre = F.when(collection_broken, F.array_union(pre["failed"], f2p)).otherwise(pre["failed"])
    return F.struct(
        F.array_sort(F.array_except(f2p, post["passed"])).alias("not_passing"),
        F.array_sort(F.array_except(post["failed"], failed_pre)).alias("broken"),
        F.array_sort(F.array_except(F.array_intersect(post["failed"], failed_pre), f2p)).alias("env_drift"),
        F.arrays_overlap(f2p, failed_pre).alias("flips"),
        (F.size(failed_pre) > 0).alias("any_failed_pre"),
    )


def verdict(runner: Column, f2p: Column, targets: Column, pre_log: Column, post_log: Column, post_status: Column, post_rc: Column, collection_broken: Column) -> Column:
    """struct<verified, reason, env_drift> of a fail-to-pass run, the tests in order.

    Exact node ids are judged test by test: each fail-to-pass test must flip, none that passed may break, and tests broken on
    both sides are drift of the environment.  Other specs are judged by the run's status.
    """
    slashed = lambda a: F.transform(a, lambda x: F.translate(x, "\\", "/"))
    want = slashed(f2p)
    sets = flip(want, test_ids(pre_log), test_ids(post_log), collection_broken)
    exact = (runner == "pytest") & (F.size(f2p) > 0) & sets["any_failed_pre"] & (F.size(F.array_except(want, slashed(targets))) == 0)
    named = lambda what, a: F.concat(F.lit(what), F.left(F.array_join(a, ", "), F.lit(300)))
    tail = F.translate(F.right(post_log, F.lit(500)), "\n", " ")
    rc = post_rc.cast("string")
    reason = (
        F.when(exact & ~sets["flips"], "fail-to-pass tests already pass pre-patch; cannot verify the flip")
        .when(exact & ~post_rc.isin(0, 1), F.concat(F.lit("post-patch tests did not run cleanly (rc="), rc, F.lit("): "), tail))
        .when(exact & (F.size(sets["not_passing"]) > 0), named("fail-to-pass tests not proven post-patch (missing or failed): ", sets["not_passing"]))
        .when(exact & (F.size(sets["broken"]) > 0), named("tests broken by the gold patch: ", sets["broken"]))
        .when(~exact & (post_status != "pass"), F.concat(F.lit("post-patch tests did not pass ("), post_status, F.lit(", rc="), rc, F.lit("): "), tail))
        .otherwise("fail-to-pass verified")
    )
    ok = reason == "fail-to-pass verified"
    return F.struct(ok.alias("verified"), reason.alias("reason"), F.when(ok & exact, sets["env_drift"]).otherwise(F.array().cast("array<string>")).alias("env_drift"))


def run_note(status: Column, seconds: Column, returncode: Column, message: Column, warnings: Column, unsupported: Column, body: Column) -> Column:
    """The observation of a test run."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("status="), status), F.format_string("duration=%.1fs", seconds), F.concat(F.lit("returncode="), returncode.cast("string")), F.concat(F.lit("message="), message),
        F.when(F.size(warnings) > 0, F.concat(F.lit("warnings="), F.array_join(warnings, " | "))),
        F.when(F.size(unsupported) > 0, F.concat(F.lit("unsupported_limits="), F.array_join(unsupported, ", "))),
        F.when(body != "", F.concat(F.lit("\n"), body)),
    )


def kept_replay(messages: Column) -> Column:
    """Whether a replayed transcript is kept: it submits, no observation is an error, and a test run passed."""
    tool = lambda m: m["role"] == "tool"
    return (
        F.exists(messages, lambda m: m["name"] == "submit")
        & ~F.exists(messages, lambda m: tool(m) & m["content"].startswith("error:"))
        & F.exists(messages, lambda m: tool(m) & (m["name"] == "run_tests") & m["content"].startswith("status=pass"))
    )
