"""Unified diffs: sections and application, as pandas UDFs (the grammar needs look-ahead and state)."""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def sections(diff: str) -> dict[str, str]:
    """Path -> section of a multi-file diff; deletions have no section, the last section of a path wins."""
    lines, starts = diff.replace("\r\n", "\n").split("\n"), []
    for i, line in enumerate(lines):
        header = line.startswith("--- ") and (not starts or (i + 1 < len(lines) and lines[i + 1].startswith("+++ ")))
        if header:
            starts.append(i)
    out: dict[str, str] = {}
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        body = lines[a:b]
        target = next((re.match(r"\+\+\+ (?:[ab]/)?(\S+)", x) for x in body if x.startswith("+++ ")), None)
        if target and target[1] != "/dev/null":
            out.pop(target[1], None)
            out[target[1]] = "\n".join(body)
    return out


def hunks(section: str) -> list[tuple[int, list[tuple[str, str]]]]:
    """(source start, [(tag, text)]) of each hunk; ValueError on a malformed one."""
    out: list[tuple[int, list[tuple[str, str]]]] = []
    left = {"-": 0, "+": 0}  # lines that the open hunk still lacks on either side; one that is overshot never ends
    for line in section.replace("\r\n", "\n").split("\n"):
        if not any(left.values()):
            if head := HUNK.match(line):
                out.append((int(head[1]), []))
                left = {side: 1 if n is None else int(n) for side, n in (("-", head[2]), ("+", head[4]))}
        elif not line.startswith("\\"):
            tag, text = line[:1] or " ", line[1:]
            if tag not in " +-":
                raise ValueError("malformed hunk line")
            for side in left if tag == " " else tag:
                left[side] -= 1
            out[-1][1].append((tag, text))
    if any(left.values()):
        raise ValueError("truncated hunk")
    if not out:
        raise ValueError("no hunks")
    return out


def apply(text: str, section: str) -> str:
    """text with a section's hunks; each at its place or the nearest match below the hunk before it."""
    text = text.replace("\r\n", "\n")
    had_newline = text.endswith("\n")
    lines = text.split("\n")[: -1 if had_newline else None] if text else []
    floor, shift = 0, 0
    for start, body in hunks(section):
        source = [t for tag, t in body if tag != "+"]
        result = [t for tag, t in body if tag != "-"]
        expected = max(start - 1, 0) + shift
        if not source:
            at = min(max(expected, floor), len(lines))
        else:
            places = [i for i in range(floor, len(lines) - len(source) + 1) if lines[i : i + len(source)] == source]
            if not places:
                raise ValueError("hunk does not match")
            at = min(places, key=lambda i: (abs(i - expected), i))
        lines[at : at + len(source)] = result
        floor = at + len(result)
        shift += len(result) - len(source)
    return "\n".join(lines) + ("\n" if lines and (had_newline or not text) else "")


def targets(diff: Column) -> Column:
    """The distinct names in the heads of a diff, of either side, in order; a new file's /dev/null is one."""
    lines = F.split(F.regexp_replace(diff, "\r\n", "\n"), "\n")
    names = F.transform(lines, lambda x: F.regexp_replace(F.regexp_extract(x, r"^(?:---|\+\+\+) (?:[ab]/)?([^\t\n]+)", 1), r"(?U)\A\s+|\s+\z", ""))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def _sections(diff: pd.Series) -> pd.Series:
    return diff.map(lambda d: [{"path": p, "body": b} for p, b in sections(d or "").items()])


def _apply(text: pd.Series, diff: pd.Series) -> pd.DataFrame:
    rows = []
    for t, d in zip(text, diff):
        try:
            rows.append((True, apply(t or "", d or ""), None))
        except ValueError as e:
            rows.append((False, None, str(e)))
    return pd.DataFrame(rows, columns=["ok", "text", "error"])


def apply_all(text: str, diffs: list[str]) -> str:
    """text with diffs applied one after another, each to what the ones before left; ValueError says which does not apply."""
    for k, diff in enumerate(diffs, 1):
        try:
            text = apply(text, diff)
        except ValueError as e:
            raise ValueError(f"edit {k} of {len(diffs)}: {e}" if len(diffs) > 1 else str(e)) from e
    return text


def _apply_chain(text: pd.Series, diffs: pd.Series) -> pd.DataFrame:
    rows = []
    for t, chain in zip(text, diffs):
        try:
            rows.append((True, apply_all(t or "", list(chain)), None))
        except ValueError as e:
            rows.append((False, None, str(e)))
    return pd.DataFrame(rows, columns=["ok", "text", "error"])


def diff_sections(diff):
    """array<struct<path, body>> of a multi-file diff column."""
    return F.pandas_udf(_sections, "array<struct<path:string,body:string>>")(diff)


def apply_diff(text, diff):
    """struct<ok, text, error>: text with the diff applied, all of it or nothing."""
    return F.pandas_udf(_apply, "struct<ok:boolean,text:string,error:string>")(text, diff)


def apply_chain(text, diffs):
    """struct<ok, text, error>: text with an array of diffs applied in order, all of them or nothing."""
    return F.pandas_udf(_apply_chain, "struct<ok:boolean,text:string,error:string>")(text, diffs)
