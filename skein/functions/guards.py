"""Guards around submissions and runs, and small predicates over tasks."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .patch import sections
from .text import protected_path, slugify

#: Fixed values
KILL_SIGNALS = [6, 9, 11, 24, 25]
ENVIRONMENT = ["environment setup failed", "pip install failed"]
OUT_OF_MEMORY = ["outofmemoryerror", "cuda out of memory"]
COUNTS = ("tests", "failures", "errors", "skipped")


def any_of(text: Column, phrases: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out


def infra_kill(returncode: Column, status: Column, message: Column) -> Column:
    """A kill by a limit or the clock, which says nothing about a patch."""
    by_signal = F.coalesce((returncode < 0) & (-returncode).isin(*KILL_SIGNALS), F.lit(False))
    return (status == "timeout") | by_signal | (F.coalesce(message, F.lit("")).contains("killed by signal") & (status != "pass"))


def episode_kind(error: Column) -> Column:
    return F.when(any_of(error, ENVIRONMENT), "environment").when(any_of(error, OUT_OF_MEMORY), "oom").otherwise("scored")


def confined(path: Column) -> Column:
    """Whether a path stays inside its root, by its letters alone."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return ~(F.translate(path, "\\", "/").startswith("/") | path.rlike("^[A-Za-z]:") | F.array_contains(parts, ".."))


def remote(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://") | url.startswith("git@")


def version_tier(version: Column, tiers: dict[float, str]) -> Column:
    """The name of the highest tier that the leading number of a version reaches, else null."""
    number = F.try_to_number(F.nullif(F.regexp_extract(version.cast("string"), r"^(\d+(?:\.\d+)?)", 1), F.lit("")), F.lit("999999999.999999")).cast("double")
    out = F.lit(None).cast("string")
    for least, name in sorted(tiers.items()):
        out = F.when(number >= least, F.lit(name)).otherwise(out)
    return out


def venv_slug(repo: Column, version: Column, tiers: dict[str, dict[float, str]]) -> Column:
    """The slug of a repository's environment, with the tier of the version where the repository has tiers."""
    out = slugify(repo)
    for name, of in tiers.items():
        tier = version_tier(version, of)
        out = F.when((repo == name) & tier.isNotNull(), F.concat(slugify(repo), F.lit("-"), tier)).otherwise(out)
    return out


def unittest_outcome(output: Column) -> Column:
    """struct<ok, reason> of a unittest runner's output."""
    ran = F.coalesce(F.regexp_extract(output, r"(?m)^Ran (\d+) tests? in ", 1), F.lit(""))
    said = output.rlike(r"(?m)^OK(?: \([^)]*\))?\s*$")
    notes = F.regexp_extract(output, r"(?m)^OK(?: \(([^)]*)\))?\s*$", 1)
    reason = (
        F.when((ran == "") | ran.rlike("^0+$"), "no tests were executed")
        .when(~said, "runner did not report OK")
        .when(notes.contains("skipped"), "target tests were skipped")
        .otherwise("tests passed")
    )
    return F.struct((reason == "tests passed").alias("ok"), reason.alias("reason"))


def _counts(text) -> tuple:
    """Sums over the suites of a JUnit report, or nulls if it does not parse."""
    try:
        suites = list(ET.fromstring(text).iter("testsuite"))
        return tuple(sum(int(s.get(k) or 0) for s in suites) for k in COUNTS)
    except (ET.ParseError, TypeError, ValueError):
        return (None,) * 4


def junit_counts(report) -> Column:
    kind = "struct<" + ",".join(f"{k}:long" for k in COUNTS) + ">"
    return F.pandas_udf(lambda s: pd.DataFrame([_counts(t) for t in s], columns=list(COUNTS)).astype("Int64"), kind)(report)


def junit_outcome(report: Column, counts: Column) -> Column:
    """struct<ok, reason> of a JUnit report and its counts."""
    reason = (
        F.when(report.isNull(), "no junit report produced")
        .when(counts["tests"].isNull(), "junit report unreadable")
        .when((counts["tests"] < 1) | (counts["tests"] - counts["skipped"] < 1), "no tests were executed")
        .when(counts["skipped"] > 0, F.concat(counts["skipped"].cast("string"), F.lit(" target test(s) skipped")))
        .when((counts["failures"] > 0) | (counts["errors"] > 0), "junit reports failures")
        .otherwise("tests passed")
    )
    return F.struct((reason == "tests passed").alias("ok"), reason.alias("reason"))


def score(status: Column, returncode: Column, message: Column, outcome: Column) -> Column:
    """struct<resolved, test_status, infra_error, reason>: a passing run counts only if its outcome is verified."""
    passed = status == "pass"
    resolved = passed & outcome["ok"]
    return F.struct(
        resolved.alias("resolved"),
        F.when(passed & ~outcome["ok"], "fail").otherwise(status).alias("test_status"),
        (infra_kill(returncode, status, message) & ~resolved).alias("infra_error"),
        F.when(passed, outcome["reason"]).otherwise(message).alias("reason"),
    )


def section_table(diff) -> Column:
    """array<struct<path, body>> in order; paths without '.' and empty parts."""

    def one(d):
        return [{"path": p, "body": b} for p, b in sections(d or "").items()]

    return F.pandas_udf(lambda s: s.map(one), "array<struct<path:string,body:string>>")(diff)


def sanitised(found: Column, test_paths: Column) -> Column:
    """struct<patch, dropped>: the sections of a submission without those that touch protected paths or test_paths."""
    bad = lambda s: protected_path(s["path"], test_paths)
    kept = F.transform(F.filter(found, lambda s: ~bad(s)), lambda s: F.regexp_replace(s["body"], "\n+$", ""))
    patch = F.when(F.size(kept) == 0, "").otherwise(F.concat(F.array_join(kept, "\n"), F.lit("\n")))
    return F.struct(patch.alias("patch"), F.transform(F.filter(found, bad), lambda s: s["path"]).alias("dropped"))


def without_token(row: Column, token: str) -> Column:
    """Whether a row's JSON does not hold a token, in any case."""
    return ~F.lower(F.to_json(row)).contains(token.lower())


def at_least(df, n: int, what: str = "rows"):
    """df; raises unless it has n rows or more."""
    have = df.limit(n).count()
    if have < n:
        raise ValueError(f"{have} {what}, at least {n} are needed")
    return df


def hours_left(budget: float | None, seconds: Column) -> Column:
    """What is left of a budget in hours after so many seconds; null without a budget."""
    return F.lit(budget).cast("double") - seconds / 3600.0 if budget else F.lit(None).cast("double")


def allowed(argv: Column, binaries: list[str]) -> Column:
    """Whether the first word of a command is on a list, by its file name without .exe."""
    name = F.regexp_replace(F.lower(F.element_at(F.split(F.translate(F.get(argv, F.lit(0)), "\\", "/"), "/"), -1)), r"\.exe$", "")
    return F.coalesce(name.isin(*binaries), F.lit(False))


#: Variables of the environment that an untrusted process may see
ENVIRONMENT_VARIABLES = (
    "PATH", "HOME", "USERPROFILE", "LOGNAME", "USER", "TMP", "TEMP", "TMPDIR", "SYSTEMROOT", "SYSTEMDRIVE", "WINDIR",
    "LANG", "LC_ALL", "LC_CTYPE", "PYTHONIOENCODING", "PYTHONHASHSEED", "PYTHONNOUSERSITE", "VIRTUAL_ENV", "CONDA_PREFIX",
)


def allowed_environment(variables: Column, names: tuple[str, ...] = ENVIRONMENT_VARIABLES) -> Column:
    """A map of variables without those that are not on the list."""
    return F.map_filter(variables, lambda k, _: k.isin(*names))


def merged(defaults: dict, given: dict | None) -> dict:
    """Defaults with the given values of known keys."""
    return dict(chain(defaults.items(), ((k, v) for k, v in (given or {}).items() if k in defaults)))
