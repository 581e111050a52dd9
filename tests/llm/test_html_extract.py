"""HTML extraction: markup rules, line alignment, and page differencing."""

import os
import random
import re
import time
from html.parser import HTMLParser

import pytest

from seqloom.llm import html_extract as op

SF = "/root/testdata/sf0.001"
CASES = [
    ("<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li>menu</li></ul></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one\n <b>two</b><br>three</p><p>four</article><footer>f</footer>", ["A & B", "one two three", "four"]),
    ("<article><p>x<aside>side</aside></p><div id='comments'><p>nice</p></div><form><input><p>mail</form><p class='cookie-notice'>c</p><p>y&#233;&nbsp;z</p></article>", ["x", "yé z"]),
    ("<div class='ad'>unclosed <article><p>text</p></article>", ["text"]),
    ("<article><header><h1>Head</h1></header><p hidden>no</p><p style='display: none'>no</p><p>a < b</p></article>", ["Head", "a < b"]),
    ("<main><table><tr><td>1<td>2</table><!-- <p>no</p> --><p title='a>b'>p</main>", ["1", "2", "p"]),
    ("<article><p class=it's>Hello</p><p title=a\"b>there</p><p data-x='a>b' class=\"c>d\">end</p></article>", ["Hello", "there", "end"]),
    ("<article><p>a</p><article class='comment'><p>no</p></article><p>b</p></article>", ["a", "b"]),
]


@pytest.mark.parametrize(("html", "lines"), CASES)
def test_article_lines(html, lines):
    assert op.blocks(html)[0] == lines


@pytest.mark.parametrize("html", ["<a " * 200_000, "<" * 300_000, "<div>" * 50_000 + "</b>" * 50_000, "<a x='" * 100_001 + ">", "<a b=  " * 100_000, "<!--" * 100_000, "&" * 300_000, "<p>" * 100_000, "<article><aside>" * 30_000])
def test_hostile_markup_takes_linear_time(html):
    began = time.perf_counter()
    op.blocks(html + "<p>end</p>")
    assert time.perf_counter() - began < 5


def test_a_very_long_page(spark):
    words = " ".join(f"w{i}" for i in range(300_000))
    got = op.extract(spark.createDataFrame([(1, "http://h/a", f"<nav>menu</nav><article><p>{words}</p></article>")], "page_id long, url string, html string")).first()
    assert got.text == words and got.n_chars == len(words)


class ByLibrary(HTMLParser):
    """The lines of a page's article, read by the standard library's parser; what is left out follows the same rules of tags, roles and classes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.lines, self.held = [], [], []

    def end_line(self):
        line = " ".join("".join(self.held).split())
        self.held = []
        if line:
            self.lines.append(line)

    def handle_starttag(self, tag, attrs):
        if tag in op._BLOCK:
            self.end_line()
        if tag == "br":
            self.held.append(" ")
        if tag in op._VOID:
            return
        inside = any(t in op._REOPENS and not why for t, why in self.open)
        text = "".join(f' {k}="{v}"' if v is not None else f" {k}" for k, v in attrs)
        self.open.append((tag, tag in ("script", "style", "noscript", "template", "iframe", "svg", "title", "textarea", "select", "object") or bool(op._dropped(tag, text, inside))))

    def handle_endtag(self, tag):
        if tag in op._BLOCK:
            self.end_line()
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t in op._REOPENS for t, _ in self.open) and not any(why for _, why in self.open):
            self.held.append(data)


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables aren't here")
def test_given_pages_as_the_library_reads_them(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in op.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) > 0
    for r in rows:
        parser = ByLibrary()
        parser.feed(r.html or "")
        parser.close()
        parser.end_line()
        assert got[r.page_id] == "\n\n".join(parser.lines), r.page_id


def brute(rows):
    """The whole query: each page against every page of its host, by the distance of the paths' order."""
    parsed = {i: op.blocks(html or "") for i, _, html in rows}

    def where(url):
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", url)
        return m.groups() if m else ("", re.match(r"[^?#]*", url)[0])

    order = sorted((*where(url), i) for i, url, _ in rows if not parsed[i][2] or parsed[i][1])
    out = {}
    for at, (host, path, i) in enumerate(order):
        lines = parsed[i][1]
        beside = []
        for side in (reversed(order[:at]), order[at + 1 :]):
            for h, p, j in side:
                if h != host:
                    break
                if parsed[j][2] or not op.copies(lines, parsed[j][1]):
                    beside.append((len(os.path.commonprefix([p, path])), parsed[j][1]))
                    break
        near = max(beside, key=lambda x: x[0], default=(0, []))[1]
        # A longest common subsequence by the textbook, of lines that don't repeat within a page, so that it is the only one.
        best = [[(0, ())] * (len(near) + 1) for _ in range(len(lines) + 1)]
        for a, x in enumerate(lines):
            for b, y in enumerate(near):
                best[a + 1][b + 1] = (best[a][b][0] + 1, (*best[a][b][1], a)) if x == y else max(best[a][b + 1], best[a + 1][b], key=lambda v: v[0])
        out[i] = "\n\n".join(x for a, x in enumerate(lines) if a not in best[-1][-1][1])
    return {i: "\n\n".join(parsed[i][0]) if parsed[i][2] else out.get(i, "") for i, *_ in rows}


def test_whole_query_equals_brute_force(spark):
    """Unmarked pages with menus of their host, in any share; some pages mark an article and have lines outside."""
    rng = random.Random(7)
    rows = []
    for i in range(90):
        host, section = rng.choice("xyz"), rng.choice("abc")
        menu = [f"menu {host} {k}" for k in range(rng.choice([2, 8]))] if rng.random() < 0.5 else [f"menu {host} {k}" for k in range(8)]
        own = [" ".join(rng.choice("lorem ipsum dolor sit amet".split()) + str(rng.randrange(1000)) for _ in range(9)) for _ in range(rng.randrange(1, 7))]
        body = "".join(f"<div>{x}</div>" for x in [*menu, *own, f"foot {host}"])
        if i % 9 == 0:
            body = "".join(f"<div>{x}</div>" for x in menu) + "<article>" + "".join(f"<p>{x}</p>" for x in own) + f"</article><div>foot {host}</div>"
        rows.append((i, f"http://{host}.org/{section}/{rng.randrange(50):02}/{i}", body))
    rows += [(100 + k, rows[k + 1][1] + "x", rows[k + 1][2]) for k in range(5)]  # copies
    got = {r.page_id: r.text for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == brute(rows)


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(op.shared_lines(a, b))
        assert len(found) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_pages(spark):
    page = lambda *lines: "<body><div>Site name</div>" + "".join(f"<div>{x}</div>" for x in lines) + "<div>All rights</div></body>"
    rows = [
        (1, "http://h.org/a/1", page("first", "text", "body", "more")), (2, "http://h.org/a/2?x=1", page("second", "own", "words", "again")), (3, "http://other.org/a/1", page("alone")),
        (4, "http://h.org/b", "<article><p>kept</p></article>"), (5, None, None), (6, "", "plain words"), (7, "http://h.org/a/1", page("first", "text", "body", "more")), (None, "x", "<p>no id"),
    ]
    pages = spark.createDataFrame([(*r, "x", [1]) for r in rows], "page_id long, url string, html string, text string, lines array<int>")
    got = {r.page_id: r for r in op.extract(pages).collect()}
    assert len(got) == len(rows)
    assert got[2].text == "second\n\nown\n\nwords\n\nagain" and got[2].n_chars == len(got[2].text)
    assert got[3].text == "Site name\n\nalone\n\nAll rights"
    assert got[4].text == "kept" and got[5].text == "" and got[5].n_chars == 0 and got[None].text == "no id"
    assert got[1].text == got[7].text  # copies of each other


def test_boilerplate_goes_whatever_its_share(spark):
    """Ten shared lines against six own ones, beside copies, and beside an almost equal page; in few and many ranges."""
    rng = random.Random(2)
    article = lambda: [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(99)) for _ in range(12)) for _ in range(6)]
    own = [article() for _ in range(3)]
    html = lambda lines: "".join(f"<div>{x}</div>" for x in [*(f"menu {i}" for i in range(10)), *lines])
    edited = [own[0][0] + " edited", *own[0][1:]]
    texts = [own[0]] * 20 + [edited] + [own[1]] * 2 + [own[2]]
    pages = spark.createDataFrame([(i, f"http://h.org/a/{i:03}", html(x)) for i, x in enumerate(texts)], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.page_id: r.text for r in op.extract(pages).collect()}
        assert got == {i: "\n\n".join(x) for i, x in enumerate(texts)}
    spark.conf.set("spark.sql.shuffle.partitions", before)


def kept_of(pages):
    state = {"seen": [], "groups": [], "closed": False}
    for p in pages:
        yield p, state
        state = op.remember(state, p)


def test_a_different_page_behind_many_copies(spark):
    """More copies than are held whole lie on both sides of the only different page of a host. On host e each is edited in a word or two, on host m in so
    many that what is kept of them can't tell for some pages whether all are copies; on host f one form is filled in."""
    rng = random.Random(3)
    rows, html = [], lambda host, lines: "".join(f"<div>{x}</div>" for x in [*(f"menu {host} {k}" for k in range(5)), *lines])
    for host in "emf":
        base = [[f"{host}{a}.{b}" for b in range(10)] for a in range(5)]
        for i in range(61):
            lines = [[w if host == "f" or rng.random() > {"e": 0.02, "m": 0.05}[host] else f"m{rng.randrange(5)}" for w in x] for x in base]
            if host == "f":
                lines.append([f"own{i}.{k}" for k in range(3)])
            if i == 30:
                lines = [[f"other {host} {k}"] for k in range(4)]
            rows.append((len(rows), f"http://{host}.org/{i:03}", html(host, [" ".join(x) for x in lines])))
    want = brute(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.page_id: r.text for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", before)
    pages = [{"host": u[7], "path": u, "marked": False, "h": hash(h), "lines": op.blocks(h)[1]} for _, u, h in rows]
    found = [op.nearest(state, p) for p, state in kept_of(pages)]
    assert any(x["open"] for x in found) and sum(x["different"] for x in found) > 70


def test_what_is_kept_never_misses_a_different_page():
    """Against all earlier pages, in ranges of any length; where it can't tell it says so."""
    rng, opened, told = random.Random(8), 0, 0
    for turn in range(30):
        base, pages = [f"b{k}" for k in range(rng.choice([10, 20, 50]))], []
        for i in range(80):
            share = rng.choice([0, 0.02, 0.05]) if turn % 2 else 0.04
            lines = [w if rng.random() >= share else f"m{rng.randrange(5)}" for w in base] + [f"own{i}.{k}" for k in range(rng.randrange(3) if turn % 3 else 0)]
            lines = [f"x{rng.randrange(50)}"] * 9 if rng.random() < 0.02 else [] if rng.random() < 0.01 else lines
            pages.append({"host": "h" if i < 60 else "k", "path": f"/{i:02}", "marked": rng.random() < 0.01, "h": hash(tuple(lines)), "lines": lines})
        cuts, carried, at = sorted(rng.sample(range(1, 80), 4)), {"seen": [], "groups": [], "closed": False}, 0
        for a, b in zip([0, *cuts], [*cuts, 80], strict=True):
            state, alone = op._loaded(op._stored(carried)), {"seen": [], "groups": [], "closed": False}
            for at, p in enumerate(pages[a:b], a):
                got = op.nearest(state, p)
                want = next((q for q in reversed(pages[:at]) if q["host"] == p["host"] and (q["marked"] or not op.copies(p["lines"], q["lines"]))), None)
                assert got["open"] or got["different"] == (want is not None) and (not want or got["page"]["path"] == want["path"])
                opened, told = opened + got["open"], told + (not got["open"])
                state, alone = op.remember(state, p), op.remember(alone, p)
                assert len(state["seen"]) <= op.VARIANTS and len(state["groups"]) <= op.VARIANTS + 1
            carried = op.follow(carried, alone)
    assert 0 < opened < told / 10


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h.org/{rng.choice('ab')}/{i}", "<div>top</div>" + "".join(f"<div>{rng.randrange(30)}</div>" for _ in range(6)) + "<div>end</div>") for i in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, op.extract(pages).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_empty_table(spark):
    assert op.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
