"""Main text of web pages: markup rules, then differencing against the page with the nearest URL.

A page is read once into blocks of text. Elements that never hold the article (navigation, headers, footers, sidebars, forms, adverts, notices,
comments, scripts, hidden parts) are left out by tag, role, class or id. Where a page marks its article, that is the text. Elsewhere the page's
lines are aligned with those of the page whose URL path is nearest on the same host, copies being passed over however many, by a longest common subsequence, and shared lines, which
belong to the site and not to the page, go. Lines inside a marked article are never compared: copies and quoted passages share those.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from seqloom.llm.common import map_arrow, materialize

#: The newest different pages of a host that are held whole, and the groups that hold what lies behind them. So many copies and no different page make a form.
VARIANTS = 16
#: Words of a page beyond which they are counted anew each time, which bounds what a worker holds.
HELD_WORDS = 20_000
#: A quote opens a value only behind an equals sign; anywhere else, as in class=it's, it is a character like others. Nothing is tried twice.
_VALUE = r"=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?"
_ATTRS = rf"(?:{_VALUE}|[^>=])*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|select|object|xmp)\b{_ATTRS}>(?P<inside>.*?)(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})>|<[/!?][^>]*>?|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_CUT = re.compile(r"<(?:[/!?]|[a-zA-Z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_DROP = frozenset("nav aside footer form button select option menu dialog audio video canvas head label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup "
    "sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs toc footer header masthead comment comments respond reply replies disqus share sharing social related recommended recommendations "
    "pagination pager login widget toolbar skip copyright".split()
)
_REOPENS = frozenset(("article", "main"))
_COMMENTS = frozenset("comment comments respond reply replies disqus related recommended recommendations aside sidebar".split())


def _dropped(tag: str, attrs: str, in_article: bool) -> str:
    """Why an element is left out: '' if it isn't, 'hard' if no article can be in it, else 'soft'."""
    if tag in _DROP:
        return "hard" if tag == "aside" else "soft"
    if tag == "header" and not in_article:
        return "soft"
    if not attrs or tag in ("html", "body"):
        return ""
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            words = set(re.split(r"[^a-z0-9]+", value)) & _BAD
            if words and (tag not in _REOPENS or words & _COMMENTS):
                return "hard" if words & _COMMENTS else "soft"
        elif name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "soft"
    return ""


def blocks(html: str) -> tuple[list[str], list[str], bool]:
    """(lines of the article, lines outside it, whether the page marks an article). Lines are in page order, trimmed, with single spaces."""
    inside: list[str] = []
    outside: list[str] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements: tag, why it is left out
    opened: Counter[str] = Counter()
    marked, depth, hard, article = False, 0, 0, 0
    # Behind the last > no tag is finished: what begins like one there is cut off.
    last = html.rfind(">") + 1
    if cut := _CUT.search(html, last):
        html = html[: cut.start()]

    def flush() -> None:
        if held:
            line = " ".join("".join(held).split())
            held.clear()
            if line:
                (inside if article else outside).append(line)

    def push(tag: str, why: str) -> None:
        nonlocal depth, hard
        stack.append((tag, why))
        opened[tag] += 1
        depth += why != ""
        hard += why == "hard"

    def pop() -> None:
        nonlocal depth, hard, article
        tag, why = stack.pop()
        opened[tag] -= 1
        depth -= why != ""
        hard -= why == "hard"
        article -= tag in _REOPENS and why == ""

    for m in _TOKEN.finditer(html):
        tag = m["tag"]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                if not depth:
                    held.append(unescape(text) if "&" in text else text)
            elif m["raw"] and m["raw"].lower() not in ("script", "style"):
                held.append("" if depth else " ")
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            flush()
        elif tag == "br" and not depth:
            held.append(" ")
        if m["close"]:
            while opened[tag]:
                inner = stack[-1][0]
                pop()
                if inner == tag:
                    break
            continue
        if tag in _VOID:
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag or tag in _BLOCK and stack and stack[-1][0] == "p":
            pop()
        if tag in _REOPENS and depth and not hard:
            while depth:  # an element before the article that wasn't closed
                pop()
        if m["attrs"].endswith("/") and tag not in _BLOCK:
            continue
        why = _dropped(tag, m["attrs"], article > 0)
        if tag in _REOPENS and not why and depth:
            why = "soft"
        push(tag, why)
        if tag in _REOPENS and not why:
            article += 1
            marked = True
    flush()
    return inside, outside, marked and bool(inside)


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence of the lines of a and b, by bit vectors: one row of bits for each line of a."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    found = set(range(start)) | set(range(len(a) - end, len(a)))
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    # Lines that b lacks are in no common subsequence.
    kept = [(start + i, where[line]) for i, line in enumerate(a) if line in where]
    full = (1 << len(b)) - 1
    v, rows = full, []
    for _, match in kept:
        u = v & match
        v = (v + u | v - u) & full
        rows.append(v)
    j = len(b)
    for i in range(len(kept) - 1, -1, -1):
        before = rows[i - 1] if i else full
        want = _length(rows[i], j) - 1
        if want < _length(before, j):
            continue
        candidates = kept[i][1] & ((1 << j) - 1)
        while candidates:
            k = candidates.bit_length() - 1
            if _length(before, k) == want:
                found.add(kept[i][0])
                j = k
                break
            candidates ^= 1 << k
    return found


def _length(row: int, j: int) -> int:
    """The length with the first j lines of b: the zeros among as many bits."""
    return j - (row & ((1 << j) - 1)).bit_count()


def difference(lines: list[str], near: list[str] | None) -> list[str]:
    """The lines that the nearest different page doesn't share, whatever their share."""
    if not near:
        return lines
    shared = shared_lines(lines, near)
    return [x for i, x in enumerate(lines) if i not in shared]


class _Bag(dict):
    """Words, how often each is there, and how many they are in all."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(counts)
        self.total = sum(self.values())


def _bag(lines: list[str]) -> _Bag:
    return _Bag(Counter(" ".join(lines).split()))


def _common(x: _Bag, y: _Bag) -> int:
    both = x.keys() & y.keys()
    return sum(map(min, map(x.__getitem__, both), map(y.__getitem__, both)))


def apart(x: _Bag, y: _Bag) -> int:
    """The words of the longer one that the other lacks: a metric on bags of words, so that apart(x, z) <= apart(x, y) + apart(y, z)."""
    return max(x.total, y.total) - _common(x, y)


def copies(a: list[str], b: list[str]) -> bool:
    """Whether pages are equal or almost equal: nine in ten words of the longer one are in the other."""
    return a == b or _almost(_bag(a), _bag(b))


def _almost(x: _Bag, y: _Bag) -> bool:
    return 10 * apart(x, y) <= max(x.total, y.total)


def _words(page: dict) -> _Bag:
    found = page.get("words")
    if found is None:
        found = _bag(page["lines"] or [])
        if len(found) <= HELD_WORDS:
            page["words"] = found
    return found


def _median(bags: list[_Bag]) -> _Bag:
    """Each word as often as over half of the bags have it."""
    counts: dict[str, list[int]] = {}
    for bag in bags:
        for word, n in bag.items():
            counts.setdefault(word, []).append(n)
    half = len(bags) // 2
    return _Bag({word: sorted(n, reverse=True)[half] for word, n in counts.items() if len(n) > half})


def _merge(newer: dict, older: dict, center: str) -> dict:
    """One group of two; center names whose center stays."""
    keep, other = (newer, older) if center == "newer" else (older, newer)
    x, y = newer["floor"], older["floor"]
    return {
        "page": newer["page"], "center": keep["center"], "radius": max(keep["radius"], apart(keep["center"], other["center"]) + other["radius"]), "floor": _Bag({w: min(x[w], y[w]) for w in x.keys() & y.keys()}),
        "shortest": min(newer["shortest"], older["shortest"]), "longest": max(newer["longest"], older["longest"]),
    }


def _absorb(groups: list[dict], new: dict, beside: list[dict]) -> list[dict]:
    """Groups, newest first by their newest page, with one more that is newer than all. It joins the first with which all pages stay copies of each
    other for certain. Else what over half of its page and the copies beside it hold becomes its center, so that their edits are left out of it.
    Beyond VARIANTS the two oldest become one, of which less can be told."""
    for i, g in enumerate(groups):
        if not g["page"]["marked"] and not new["page"]["marked"]:
            m = _merge(new, g, "older")
            if 20 * m["radius"] <= m["shortest"] or 10 * m["floor"].total >= 9 * m["longest"]:
                return [m, *groups[:i], *groups[i + 1 :]]
    if beside and not new["page"]["marked"]:
        words = new["center"]
        center = _median([words, *(w for w in map(_words, beside) if _almost(words, w))])
        new = {**new, "center": center, "radius": apart(center, words)}
    groups = [new, *groups]
    loose = [g for g in groups if not g["page"]["marked"]]
    if len(loose) > VARIANTS:
        return [*loose[:-2], _merge(*loose[-2:], "newer"), *groups[len(loose) :]]  # only the oldest can be marked
    return groups


def _single(page: dict) -> dict:
    """A group of one page."""
    words = _words(page)
    return {"page": page, "center": words, "radius": 0, "floor": words, "shortest": words.total, "longest": words.total}


def remember(state: dict, page: dict) -> dict:
    """What is kept of a host's pages with one more. seen: the newest different ones, newest first; equal pages count once, but for one that
    marks its article, which is no copy. groups: all that is
    behind them, as bounds on how far a group's pages are apart, and the newest page of each. closed: pages before these are never needed. They aren't
    behind a page that marks its article, nor behind two pages so far apart that none is a copy of both."""
    seen = state["seen"]
    if page["marked"]:
        return {"seen": [page], "groups": [], "closed": True}
    if not seen or seen[0]["host"] != page["host"]:
        return {"seen": [page], "groups": [], "closed": False}
    held = [page, *(p for p in seen if p["marked"] or p["h"] != page["h"])]
    if len(held) <= VARIANTS:
        return {**state, "seen": held}
    if not seen[0]["marked"]:
        # A copy of q is at most |q| / 9 from it: it has at most |q| / 0.9 words, and a tenth of the longer one's may differ.
        x, y = _words(page), _words(seen[0])
        if 9 * apart(x, y) > x.total + y.total:
            return {"seen": held[:2], "groups": [], "closed": True}
    last = held.pop()
    return {**state, "seen": held, "groups": _absorb(state["groups"], _single(last), [p for p in held if not p["marked"]])}


def follow(state: dict, later: dict) -> dict:
    """What is kept after a range of pages, from what was kept before it and what the range alone keeps."""
    if later["closed"] or not state["seen"] or not later["seen"] or state["seen"][0]["host"] != later["seen"][0]["host"]:
        return later if later["seen"] else state
    if not later["groups"]:
        for p in reversed(later["seen"]):
            state = remember(state, p)
        return state
    groups = state["groups"]
    for p in reversed(state["seen"]):
        groups = _absorb(groups, _single(p), [])
    for g in reversed(later["groups"]):
        groups = _absorb(groups, g, [])
    return {"seen": later["seen"], "groups": groups, "closed": state["closed"]}


def _stored(state: dict) -> dict:
    spread = lambda bag: [w for w, n in bag.items() for _ in range(n)]
    return {**state, "groups": [{**g, "center": spread(g["center"]), "floor": spread(g["floor"])} for g in state["groups"]]}


def _loaded(state: dict) -> dict:
    return {**state, "groups": [{**g, "center": _bag(g["center"]), "floor": _bag(g["floor"])} for g in state["groups"]]}


def nearest(state: dict, page: dict) -> dict:
    """The nearest page of the host that is no copy (different), or that a nearer one than the groups' newest may be that (open): then all pages of the
    host are looked through. What a page has outside a marked article holds no article, so that page is never a copy. As many different pages as
    VARIANTS that are all almost equal may be no copies but fill in one form: the farthest of them is named, for a host without any different page."""
    seen = state["seen"]
    if not seen or seen[0]["host"] != page["host"]:
        return {"open": False, "different": False, "page": None}
    words = _words(page)
    for p in seen:
        if p["marked"] or p["h"] != page["h"] and not _almost(words, _words(p)):
            return {"open": False, "different": True, "page": p}
    form = seen[-1] if len(seen) == VARIANTS and all(p["h"] != page["h"] for p in seen) else None
    n = words.total
    for g in state["groups"]:
        if g["page"]["marked"] or not _almost(words, _words(g["page"])):
            return {"open": False, "different": True, "page": g["page"]}
        if 10 * (apart(words, g["center"]) + g["radius"]) > max(n, g["shortest"]) and 10 * _common(words, g["floor"]) < 9 * max(n, g["longest"]):
            return {"open": True, "different": False, "page": form}
    return {"open": False, "different": False, "page": form}


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def own_lines(path: str, lines: list[str] | None, sides: list[dict]) -> str:
    """A page's text: its lines without those of the nearest of the pages beside it; a form's are taken only where no page is different."""
    beside = [s["page"] for s in sides if s["different"]] or [s["page"] for s in sides if s["page"]]
    near = max(beside, key=lambda n: _alike(n["path"], path), default=None)
    return "\n\n".join(difference(lines or [], near and near["lines"]))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of pages; a null html counts as empty and gives an empty text.

    Pages with the same URL, or none, are paired like any others (a page is never paired with itself). Columns other than page_id, url and html
    are not read.
    """
    narrow = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def parse(batches):
        for batch in batches:
            found = [blocks(h) for h in batch.column("html").to_pylist()]
            columns = [
                batch.column("page_id"), batch.column("url"), pa.array([marked for *_, marked in found], pa.bool_()), pa.array(["\n\n".join(inside) if marked else None for inside, _, marked in found], pa.string()),
                pa.array([outside for _, outside, _ in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "marked", "text", "lines"])

    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    ids = f"page_id {kinds['page_id']}, url {kinds['url']}"
    # Every page is parsed once; what is read again below is its text and lines, and only for pages that have lines outside an article.
    parsed = materialize(map_arrow(narrow, parse, f"{ids}, marked boolean, text string, lines array<string>"), "pages")
    text = parsed.where("marked").select("page_id", "url", "text")
    rest = parsed.where("not marked or size(lines) > 0").select("page_id", "url", "marked", "lines")
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    key = F.struct(host.alias("host"), path.alias("path"), "page_id", F.xxhash64("lines").alias("h")).alias("key")
    dealt = rest.select(key, "url", "marked", "lines").repartitionByRange("key").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "outside")
    # Pages in order within a range; what is kept of those before and after a range is carried over, one row for each range.
    page = "struct<host string, path string, marked boolean, h long, lines array<string>>"
    kept = f"struct<seen array<{page}>, groups array<struct<page {page}, center array<string>, radius long, floor array<string>, shortest long, longest long>>, closed boolean>"
    side = f"struct<open boolean, different boolean, page {page}>"
    flat = dealt.select("part", "key", "url", F.struct("key.host", "key.path", "marked", "key.h", "lines").alias("page"))
    kept_arrow, side_arrow = (to_arrow_type(_parse_datatype_string(x)) for x in (kept, side))
    nothing = {"seen": [], "groups": [], "closed": False}

    def edge(batches):
        """What each range alone keeps of its pages."""
        part, state = None, nothing
        row = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_stored(state)], kept_arrow)], ["part", "kept"])
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part:
                    if part is not None:
                        yield row()
                    part, state = r["part"], nothing
                state = remember(state, r["page"])
        if part is not None:
            yield row()

    def carry(batches):
        """What is kept of all pages before each range."""
        state = nothing
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([_stored(state)], kept_arrow)], ["part", "kept"])
                state = follow(state, _loaded(r["kept"]))

    def beside(name: str):
        """Each range's pages behind the row of what is kept before it, which isn't given out."""

        def work(batches):
            state = nothing
            for batch in batches:
                found, mask = [], []
                for r in batch.to_pylist():
                    mask.append(r["kept"] is None)
                    if r["kept"] is not None:
                        state = _loaded(r["kept"])
                        continue
                    found.append(None if r["page"]["marked"] else nearest(state, r["page"]))
                    state = remember(state, r["page"])
                rows = batch.remove_column(batch.schema.get_field_index("kept")).filter(pa.array(mask, pa.bool_()))
                yield rows.append_column(name, pa.array(found, side_arrow))

        return work

    key_kind = dealt.schema["key"].dataType.simpleString()
    rows, columns = flat, f"part int, key {key_kind}, url {kinds['url']}, page {page}"
    for name, order, ends_order in (("before", F.asc_nulls_first("key"), F.asc("part")), ("after", F.desc_nulls_first("key"), F.desc("part"))):
        ends = map_arrow(flat.select("part", "key", "page").repartition("part").sortWithinPartitions("part", order), edge, f"part int, kept {kept}")
        ends = materialize(map_arrow(ends.coalesce(1).sortWithinPartitions(ends_order), carry, f"part int, kept {kept}"), f"ends-{name}")
        rows = rows.withColumn("kept", F.lit(None).cast(kept)).unionByName(ends, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", order)
        columns = f"{columns}, {name} {side}"
        rows = map_arrow(rows, beside(name), columns)
    rows = rows.where("not page.marked").select("key", "url", "page.lines", "before", "after")

    ask = f"struct<id string, key {key_kind}, lines array<string>, before {side}, after {side}>"
    ask_arrow = to_arrow_type(_parse_datatype_string(ask))

    def diff(batches):
        """Texts; rows that are open on a side go on as they are."""
        for batch in batches:
            texts, asks = [], []
            for r in batch.select(["key", "lines", "before", "after"]).to_pylist():
                sides = [r["before"], r["after"]]
                later = any(x["open"] for x in sides)
                texts.append(None if later else own_lines(r["key"]["path"], r["lines"], sides))
                asks.append({"id": uuid.uuid4().hex, **r} if later else None)
            yield pa.RecordBatch.from_arrays([batch.column("key").field("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(asks, ask_arrow)], ["page_id", "url", "text", "ask"])

    settled = materialize(map_arrow(rows, diff, f"{ids}, text string, ask {ask}"), "settled")
    out = text.unionByName(settled.where("ask is null").select("page_id", "url", "text"))
    asked = settled.where("ask is not null").select("page_id", "url", "ask.*")
    if not asked.isEmpty():
        out = out.unionByName(_looked_through(asked, dealt, f"{ids}, text string"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _looked_through(asked: DataFrame, dealt: DataFrame, schema: str) -> DataFrame:
    """The texts of rows that are open on a side: each is held against every page of its host on that side, in the ranges where those are."""
    sides = [asked.where(f"{name}.open").select("id", F.lit(name).alias("side"), F.col("key").alias("own"), F.col("lines").alias("mine")) for name in ("before", "after")]
    ranges = dealt.groupBy(F.col("key.host").alias("host"), "part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    within = sides[0].unionByName(sides[1]).join(ranges, (F.col("own.host") == F.col("host")) & F.expr("if(side = 'before', low < own, high > own)"))
    pages = dealt.select("part", F.col("key.host").alias("host"), "key", "marked", "lines")
    pairs = within.drop("low", "high").join(pages, ["part", "host"]).where("if(side = 'before', key < own, key > own)").select("id", "side", "mine", "key", "marked", "lines")

    def different(batches):
        held: dict[str, _Bag] = {}
        n = 0

        def words(lines: list[str]) -> _Bag:
            nonlocal n
            text = " ".join(lines)
            found = held.get(text)
            if found is None:
                found = _bag([text])
                n += len(found)
                if n > 20 * HELD_WORDS:
                    held.clear()
                    n = len(found)
                held[text] = found
            return found

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("mine", "marked", "lines"))
            mask = [marked or not _almost(words(mine), words(lines)) for mine, marked, lines in zip(*columns, strict=True)]
            yield batch.select(["id", "side", "key", "lines"]).filter(pa.array(mask, pa.bool_()))

    key_kind = dealt.schema["key"].dataType.simpleString()
    found = map_arrow(pairs, different, f"id string, side string, key {key_kind}, lines array<string>").withColumn("near", F.struct("key.path", "lines"))
    at = lambda pick, name: pick(F.when(F.col("side") == name, F.col("near")), F.when(F.col("side") == name, F.col("key"))).alias(f"found_{name}")
    found = found.groupBy("id").agg(at(F.max_by, "before"), at(F.min_by, "after"))

    def diff(batches):
        for batch in batches:
            texts = []
            for r in batch.to_pylist():
                both = [{"different": True, "page": r[f"found_{name}"]} if r[f"found_{name}"] else r[name] for name in ("before", "after")]
                texts.append(own_lines(r["key"]["path"], r["lines"], both))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return map_arrow(asked.join(found, "id", "left"), diff, schema)
