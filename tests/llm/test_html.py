"""Page differencing against brute force over all pages of a host, at several partitionings."""

import random
from html.parser import HTMLParser

import pytest

from skein.llm import html
from skein.llm.urlfilter import split_url  # noqa: F401

rnd = random.Random(3)
SCHEMA = "page_id long, url string, html string, host string"


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 20])
def test_common_lines_are_a_longest_subsequence(monkeypatch, bits):
    monkeypatch.setattr(html, "TABLE_BITS", bits)
    for k in range(400):
        a, b = ([rnd.choice("abcdefgh"[: 2 + k % 7]) for _ in range(rnd.randrange(14))] for _ in range(2))
        found = sorted(html.common_lines(a, b))
        assert len(found) == lcs(a, b), (a, b, found)
        rest = iter(b)
        assert all(a[i] in rest for i in found), (a, b, found)  # in order in b


def test_many_equal_lines_and_open_elements_are_quick():
    a, b = ["x"] * 4000 + ["y"] + ["x"] * 100, ["z"] + ["x"] * 4050
    assert len(html.common_lines(a, b)) == 4050
    assert html.blocks("<div>" * 20000 + "</b>" * 20000 + "t") == [("t", False, False, False)]


def host_of(url):
    return (url or "").partition("://")[2].partition("/")[0] if "://" in (url or "") else ""


class Reader(HTMLParser):
    """Lines of a well-formed page: (text, in main, off, heading)."""

    def __init__(self):
        super().__init__()
        self.open, self.words, self.lines = [], [], []

    def end_line(self):
        text = " ".join(" ".join(self.words).split())
        if text:
            tags = [t for t, _ in self.open]
            off = any(t in ("nav", "footer", "aside", "form") or c in ("ad", "comments") for t, c in self.open)
            self.lines.append((text, "main" in tags or "article" in tags, off, "h1" in tags or "h2" in tags))
        self.words = []

    def handle_starttag(self, tag, attrs):
        self.end_line()
        self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        self.end_line()
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.words.append(data)


def read(page):
    reader = Reader()
    reader.feed(page or "")
    reader.end_line()
    return reader.lines


def on_common(a, b):
    """Positions of a on the longest common subsequence with b that the table gives from its end."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    out, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def brute(rows):
    """The text of every row: neighbours are sought along the whole host, with a parser, an alignment and rules of its own."""
    keyed = []
    for i, url, page in rows:
        host = host_of(url)
        path = "/" + url.partition("://")[2].partition("/")[2] if host else ""
        keyed.append((host, path, -(2**63) if i is None else i, [x[0] for x in read(page)], read(page), i))
    out = []
    for host, path, k, lines, found, i in keyed:
        mine = [(x[1], x[2], x[3]) for x in keyed if x[0] == host and x[3] != lines]
        before = max((x for x in mine if x[:2] < (path, k)), default=None, key=lambda x: x[:2])
        after = min((x for x in mine if x[:2] > (path, k)), default=None, key=lambda x: x[:2])
        shared = set().union(*[on_common(lines, x[2]) for x in (before, after) if x])
        main = {n for n, (_, m, o, _) in enumerate(found) if m and not o}
        same, all_words = (sum(lines[n].count(" ") + 1 for n in part) for part in (main & shared, main))
        kept = []
        for n, (text, _, off, heading) in enumerate(found):
            if off or (main and n not in main):
                continue
            if n in shared and not main:
                continue
            if n in shared and not (heading or text[-1] in ".!?" or text.count(" ") >= 11 or same > 0.8 * all_words):
                continue
            kept.append(text)
        out.append((i, "\n".join(kept)))
    return sorted(out, key=str)


def page(*lines, main=False):
    body = "".join(f"<div>{x}</div>" for x in lines)
    return f"<nav>Home</nav><p>Rules</p>{'<main>' + body + '</main>' if main else body}<p>End</p>"


ROWS = [(k, f"http://h.org/p{k:02d}", page("copy") if 2 <= k <= 17 else page(f"own {k}", "quoted.", main=k % 3 == 0)) for k in range(24)]
ROWS += [(100 + k, f"http://g.org/p{k:02d}", page("same everywhere")) for k in range(12)]
ROWS += [(200, "http://one.org/", page("alone")), (None, None, page("null")), (201, None, None), (202, "http://two.org/x", ""), (None, "http://h.org/p30", page("z")), (203, "http://two.org/long", page(*["w%d" % (i % 50) for i in range(3000)]))]


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_text_does_not_depend_on_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = [(*r, "clash") for r in ROWS + ROWS[3:5]]
        rnd.shuffle(rows)
        got = html.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(((r.page_id, r.text) for r in got), key=str) == brute([r[:3] for r in rows])
    text = {r.page_id: r.text for r in got}
    assert text[3] == "copy" and text[1] == "own 1" and text[0] == "own 0\nquoted." and text[100] == "Rules\nsame everywhere\nEnd"
    # alignment has its say on every page with a neighbour
    assert all(r.n_shared > 0 for r in got if r.page_id is not None and r.page_id < 24)


LABELS = ["Share this article", "Read more", "Print", "3 min read"]
QUOTES = ["To be quoted, or not.", "Many pages of the host quote this sentence of some length without any stop", "Short quote!"]


def article(k, labels, quotes, own=4):
    """A page whose labels stand inside its article."""
    body = [f"<p>Own line {k} {n} of the text</p>" for n in range(own)]
    for n, q in enumerate(quotes):
        body.insert(2 * n + 1, f"<p>{q}</p>")
    for n, label in enumerate(labels):
        body.insert(n * 2, f"<div>{label}</div>")
    return f"<nav>Home</nav><div class=\"ad\">Buy {k}</div><article><h1>Weekly column</h1>{''.join(body)}</article><footer>End</footer>"


def test_template_lines_inside_an_article_go_and_quoted_passages_stay(spark):
    rows = [(k, f"http://h.org/p{k}", article(k, LABELS, QUOTES)) for k in range(4)]
    rows += [(10 + k, f"http://g.org/p{k}", article(k, LABELS, [])) for k in range(1)]  # no neighbour: all of it stays
    rows += [(20 + k, f"http://copies.org/p{k}", f"<main><p>Read more</p><p>same text in all of them</p><p>same label</p><p>edition {k}</p></main>") for k in range(3)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(4):
        lines = got[k].text.split("\n")
        assert not set(LABELS) & set(lines) and set(QUOTES) <= set(lines) and "Weekly column" in lines and sum(x.startswith("Own") for x in lines) == 4
        assert (got[k].n_vetoed, got[k].n_shared, got[k].n_marked) == (4, 4 + 4 + 2, 1)
    assert set(LABELS) <= set(got[10].text.split("\n")) and got[10].n_shared == 0
    assert got[20].text == "Read more\nsame text in all of them\nsame label\nedition 0" and got[20].n_vetoed == 3
    assert sorted(((r.page_id, r.text) for r in got.values()), key=str) == brute(rows)


def test_another_neighbour_gives_another_text(spark):
    page, schema = article(1, ["Read more"], []), "page_id long, url string, html string"
    texts = []
    for labels in (["Read more"], ["Print"]):
        rows = [(1, "http://h.org/p1", page), (2, "http://h.org/p2", article(2, labels, []))]
        texts.append({r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, schema)).collect()}[1])
    assert "Read more" not in texts[0] and "Read more" in texts[1]


def test_random_pages(spark):
    """Common lines stand in one order on all pages, so the longest common subsequence is one alone."""
    rows = []
    for k in range(120):
        labels, quotes = sorted(rnd.sample(LABELS, rnd.randrange(4))), sorted(rnd.sample(QUOTES, rnd.randrange(3)))
        own = [f"Own line {k // rnd.choice([1, 1, 30])} {n} of the text" for n in range(rnd.randrange(4))]
        body = "".join(f"<div>{x}</div>" for x in [*labels, *own[:1], *quotes, *own[1:]])
        rows.append((k, f"http://h{k % 3}.org/p{k // 3:02d}", f"<nav>Home</nav>{'<main>' if k % 4 else ''}<h1>Weekly column</h1>{body}{'</main>' if k % 4 else ''}<footer>End</footer>"))
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.text) for r in got), key=str) == brute(rows)
