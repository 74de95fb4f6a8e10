"""Operator 4, HTML extraction by nearest-URL page differencing.

Pages are sorted by host, URL path, id and lines.  A page's nearest neighbours are the last page before it and the first
after it on its host whose lines (blocks of text) differ from its own; its lines are aligned with theirs by longest common
subsequence, and lines on a common subsequence are template lines and go.

Differencing alone cannot give right results: articles of a host quote the same passages, pages are copies of each other but
for a line, and many hosts have one page.  So a narrow veto and the page's own marks come after it.  A shared line inside an
article or main element goes like any other unless it reads as text (BODY_WORDS words or more, or the end of a sentence), is
a heading, or more than COPIED of the element's words are in shared lines, which makes the page a copy; n_vetoed counts the
lines that stay so.  And marks settle what alignment left: an unshared line goes if it is in an element that is navigation, header, footer, sidebar,
notice, advert, form or comments by its tag, role, class or id, or if it is outside the main element of a page that has one.
n_shared, n_vetoed and n_marked count the lines of each kind.

A range of the sort order is one task's work, split by rows and never by host.  A first pass finds, for every range, the
runs of equal pages at its ends, and so the nearest differing pages beyond it, however many ranges a run fills; these
pages go to the range too.  So the result does not depend on how pages are partitioned.  A run of equal pages is aligned
once, and of its pages no more than id, URL and marks are held until the next run begins.
Nulls: null html is an empty page, a null url has an empty host and path; null ids sort first.  Repeated rows stay and get
equal texts.  Very long pages are handled whole, in time and memory linear in the page (alignment: the product of the
lines that differ, 64 at a time, in bounded memory).  Empty tables give empty results.  Other columns are not returned.
"""

from __future__ import annotations

import html as _html
import pickle
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import shuffle_partitions
from .urlfilter import split_url

#: an alignment table of more bits is cut in two
TABLE_BITS = 1 << 28
#: a line of so many words is text and no label; a page is a copy if more than this share of its main words is shared
BODY_WORDS, COPIED = 12, 0.8
SENTENCE = re.compile(r"""[.!?…。！？؟।]["'”’»)\]]*\Z""")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements, by what they mean for the text.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
OFF_TAGS = {"head", "nav", "footer", "aside", "form", "noscript", "template", "iframe", "svg", "button", "select", "menu", "dialog", "object", "canvas", "video", "audio"}
OFF_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}
OFF_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "share", "sharing", "social", "related", "comment", "comments", "disqus", "replies"}
HEADER_WORDS = {"header", "masthead"}
#: elements whose end tag may be left out, and which must not hide what follows
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot", "colgroup", "html", "body", "rt", "rp"}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _kind(tag: str, attributes: str, in_main: bool) -> str:
    """'main', 'off' or ''."""
    if tag in OFF_TAGS or (tag == "header" and not in_main):
        return "off"
    words, roles, item = set(), set(), ""
    if "=" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            if name.lower() == "role":
                roles.update(value.split())
            elif name.lower() == "itemprop":
                item = value
            else:
                words.update(re.findall("[a-z0-9]+", value))
    if words & OFF_WORDS or roles & OFF_ROLES or (words & HEADER_WORDS and not in_main):
        return "off"
    return "main" if tag in ("article", "main") or "main" in roles or item == "articlebody" else ""


def blocks(page: str) -> list[tuple[str, bool, bool, bool]]:
    """(text, in a main element, in an element that holds no text of the article, in a heading) of every block in page order."""
    out: list[tuple[str, bool, bool, bool]] = []
    piece: list[str] = []
    stack: list[tuple[str, str]] = []
    opened: Counter = Counter()
    n_main = n_off = 0

    def flush():
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                out.append((text, n_main > 0, n_off > 0, any(opened[h] for h in HEADINGS)))
            piece.clear()

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            piece.append(_html.unescape(page[at:lt]))
        if lt == end:
            break
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        tag = TAG.match(page, lt)
        if not tag:
            if re.match("</?[a-zA-Z]", page[lt : lt + 3]):  # a tag that never ends
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
            else:
                piece.append("<")
                at = lt + 1
            continue
        at = tag.end()
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name not in INLINE and name not in ("script", "style"):
            flush()
        if closing:
            if opened[name]:
                while True:
                    t, kind = stack.pop()
                    opened[t] -= 1
                    n_main -= kind == "main"
                    n_off -= kind == "off"
                    if t == name:
                        break
            continue
        if name in RAW:
            close = re.compile(f"</{name}", re.I).search(page, at)
            if not close:
                break
            gt = page.find(">", close.end())
            at = end if gt < 0 else gt + 1
            continue
        if name in VOID or name in LOOSE or attributes.endswith("/"):
            continue
        kind = _kind(name, attributes, n_main > 0)
        if kind or name not in INLINE:
            if kind and name in INLINE:
                flush()
            stack.append((name, kind))
            opened[name] += 1
            n_main += kind == "main"
            n_off += kind == "off"
    flush()
    return out


def _steps(a: list, b: list):
    """The bits of each row of the alignment table: bit j is clear where the length grows at b's line j."""
    places: dict = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    ones = (1 << len(b)) - 1
    v = ones
    for line in a:
        u = v & places.get(line, 0)
        v = ((v + u) | (v - u)) & ones
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of the longest common subsequence of a and every beginning of b."""
    v = (1 << len(b)) - 1
    for v in _steps(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little")
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def _aligned(a: list, b: list) -> list[int]:
    """Positions of a on a longest common subsequence with b."""
    both = set(a) & set(b)
    place = [i for i, line in enumerate(a) if line in both]
    a, b = [a[i] for i in place], [line for line in b if line in both]
    if not a:
        return []
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        # halves of a, each with its part of b
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[:half - 1 : -1], b[::-1])[::-1]))
        found = _aligned(a[:half], b[:cut]) + [half + i for i in _aligned(a[half:], b[cut:])]
        return [place[i] for i in found]
    size = len(b) // 8 + 1
    rows = [v.to_bytes(size, "little") for v in _steps(a, b)]
    found, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[i][j >> 3] >> (j & 7) & 1:
            j -= 1
        elif i and not rows[i - 1][j >> 3] >> (j & 7) & 1:
            i -= 1
        else:
            found.append(place[i])
            i, j = i - 1, j - 1
    return found


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions of a on a longest common subsequence with b."""
    n, p, q = min(len(a), len(b)), 0, 0
    while p < n and a[p] == b[p]:
        p += 1
    while q < n - p and a[-1 - q] == b[-1 - q]:
        q += 1
    middle = _aligned(a[p : len(a) - q], b[p : len(b) - q])
    return {*range(p), *range(len(a) - q, len(a)), *(p + i for i in middle)}


def main_lines(lines: list[str], in_main: list[bool], off: list[bool], heading: list[bool], shared: set[int]) -> tuple[list[str], int, int]:
    """(the text's lines, shared lines that the veto keeps, unshared lines that marks remove)."""
    main = [i for i in range(len(lines)) if in_main[i] and not off[i]]
    words = {i: len(lines[i].split()) for i in main}
    copied = sum(words[i] for i in main if i in shared) > COPIED * sum(words.values())
    kept, vetoed, settled = [], 0, 0
    for i, line in enumerate(lines):
        if off[i] or (main and not in_main[i]):
            settled += i not in shared
        elif i not in shared:
            kept.append(line)
        elif main and (copied or heading[i] or words[i] >= BODY_WORDS or SENTENCE.search(line)):
            vetoed += 1
            kept.append(line)
    return kept, vetoed, settled


def _neighbours(ranges: list[dict]) -> list[tuple[tuple, int, int, int]]:
    """(key, hash of lines, range, side) of the pages beyond each range that its first (-1) and last (1) run differ from.

    A range has its `runs` in order, each (host, hash, key); of more than four only the first and last two.
    """
    out = []
    for side, order in ((-1, range(len(ranges))), (1, range(len(ranges) - 1, -1, -1))):
        beyond = None  # the nearest differing run for the range before, if that range is a single run
        last: list = []
        for j in order:
            runs = ranges[j]["runs"][:: -side]  # from the side on inwards
            host, lines, _ = runs[0]
            near = next((r for r in last if r[0] != host or r[1] != lines), None) if last else None
            if last and near is None:
                near = beyond
            if near is not None and near[0] == host:
                out.append((near[2], near[1], j, side))
            else:
                near = None
            beyond = near if ranges[j]["n_runs"] == 1 else None
            last = runs[::-1][:2]
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_lines, n_shared, n_vetoed, n_marked) of every page; text joins the article's blocks by newlines."""
    n = shuffle_partitions(pages.sparkSession)
    host, path = split_url(F.col(url_col))
    least = F.lit(-(2**63)).cast("long")
    keyed = pages.select(
        host.alias("host"), path.alias("path"), F.coalesce(F.col(id_col).cast("long"), least).alias("k"),
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
    )

    def hashed(lines: list[str]) -> int:
        return xxhash.xxh3_64_intdigest("\n".join(lines).encode("utf-8", "replace")) - (1 << 63)

    def outline(batches):
        for batch in batches:
            lines = [hashed([b[0] for b in blocks(page or "")]) for page in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lines, pa.int64())], names=["host", "path", "k", "h"])

    def ends(batches):
        """The first and last runs of equal pages of a range, and its number of runs."""
        first, last, count, place, run = [], [], 0, None, None
        for batch in batches:
            for h, p, k, lines in zip(*[c.to_pylist() for c in batch.columns]):
                if place is None:
                    low = (h, p, k)
                place = (h, p, k)
                if run is None or run[:2] != (h, lines):
                    run = (h, lines, place)
                    count += 1
                    last = [*last[-1:], run]
                    if len(first) < 2:
                        first.append(run)
        if count:
            runs = first if count <= 2 else first + last[3 - count if count < 4 else -2 :]
            yield pa.RecordBatch.from_pydict({"r": [pickle.dumps({"low": low, "high": place, "n_runs": count, "runs": runs})]})

    light = keyed.select("host", "path", "k", "html").mapInArrow(outline, "host string, path string, k long, h long")
    light = light.repartitionByRange(n, "host", "path", "k").sortWithinPartitions("host", "path", "k", "h")
    # one row a range, four keys in it
    ranges = sorted((pickle.loads(r[0]) for r in light.mapInArrow(ends, "r binary").collect()), key=lambda r: r["low"])
    highs = [r["high"] for r in ranges]
    wanted: dict = {}
    for key, lines, j, side in _neighbours(ranges):
        wanted.setdefault((key, lines), []).append((j, side))

    def parse(batches):
        for batch in batches:
            rows = []
            for h, p, k, i, u, page in zip(*[c.to_pylist() for c in batch.columns]):
                found = blocks(page or "")
                lines, flags = [b[0] for b in found], bytes(b[1] | b[2] << 1 | b[3] << 2 for b in found)
                key, mark = (h, p, k), hashed(lines)
                rows.append((bisect_left(highs, key), 0, h, p, k, mark, i, u, lines, flags))
                rows += [(j, side, h, p, k, mark, i, None, lines, b"") for j, side in wanted.get((key, mark), ())]
            kinds = [pa.int32(), pa.int8(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.binary()]
            names = ["j", "side", "host", "path", "k", "h", "id", "url", "lines", "flags"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 10, kinds)], names=names)

    parsed = keyed.mapInArrow(parse, "j int, side byte, host string, path string, k long, h long, id long, url string, lines array<string>, flags binary")
    dealt = parsed.repartitionById(n, "j").sortWithinPartitions("j", "side", "host", "path", "k", "h")

    def difference(batches):
        """Runs of equal pages of one host; a run is done when the next begins."""
        run: list = []
        place, lines, before, out = None, None, None, []

        def done(after):
            if not run:
                return
            shared: set = set()
            for other in (before, after):
                if other is not None:
                    shared |= common_lines(lines, other)
            for i, url, flags in run:
                text, vetoed, settled = main_lines(lines, *[[bool(f & bit) for f in flags] for bit in (1, 2, 4)], shared)
                out.append((i, url, "\n".join(text), len(lines), len(shared), vetoed, settled))

        def batch_of(rows):
            kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int32()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[id_col, url_col, "text", "n_lines", "n_shared", "n_vetoed", "n_marked"])

        for batch in batches:
            for r in batch.to_pylist():
                here = (r["j"], r["host"])
                if here != place or r["lines"] != lines:
                    done(r["lines"] if here == place else None)
                    before = lines if here == place else None
                    place, lines, run = here, r["lines"], []
                if not r["side"]:
                    run.append((r["id"], r["url"], r["flags"]))
            if out:
                yield batch_of(out)
                out.clear()
        done(None)
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(difference, f"{id_col} long, {url_col} string, text string, n_lines int, n_shared int, n_vetoed int, n_marked int")
