"""Main text of web pages by equivalence classes of tokens over the pages of a host.

A token is a container or a block of text, each with the path of containers (names and classes) around it. Tokens with equal occurrence vectors over the
pages of a host (so many times in this page, so many in that) form a class; vectors are compared by sums of page hashes times counts, which add up
over partitions, so a host with a third of all pages is aggregated like any other. A class is valid if

* it occurs in at least half of the host's pages and has two tokens or more (that of all pages may have one),
* it isn't most of the text of those pages, as copies of one article are, unless it is that of all pages,
* its tokens, if they come once a page, stand in the same order in every page,
* and it nests: all its tokens lie between two neighbours of any other such class, or the other way round; else the rarer one falls.

The valid classes are the host's template, and what lies between their tokens are its slots. The main container is the template's ``article`` or ``main`` with
the most text in its slots, else the deepest container that holds the text of all slots but those of containers named as adverts, comments and the like. A
page's text is what its slots hold within the main container. Text that the template fixes goes with it, but what stands directly in an ``article`` or ``main`` is the author's.

Passes: one proposes tokens that are frequent among some of a host's pages (a token of half of all pages is so somewhere), one counts these exactly, one tests order and
nesting and measures slots, one extracts. Rows between them are counters; pages are never shuffled unless the templates are too large to broadcast.

A page of a host with fewer than LEAST_PAGES pages, or one that lacks the main container, is judged alone: its ``article`` or ``main``, else the deepest
container with all of its text, without containers that are named so.

Cases: null or empty html has empty text; a null url belongs to the host ''; unclosed tags, comments and scripts end where the
page ends; equal pages give equal text; ties between containers go to the one opened later; an empty table gives an empty
table; other columns are ignored; pages are read whole.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import Scratch, at_work, flagged, flags_of, prepare

#: A template needs so many pages of a host, and a token half of them.
LEAST_PAGES = 3
#: Counters that a task holds before it passes them on.
HELD_TOKENS = 200_000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PARTS = re.compile(r"[^a-z0-9]+")
#: Fixed by HTML: elements whose content is not markup, elements without content, elements that hold others as a block.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"article", "aside", "body", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "head", "header", "html", "main", "menu", "nav", "noscript", "ol", "section", "table", "tbody", "template", "ul", "svg", "select", "button", "object", "math"}
BLOCKS = CONTAINERS | {"address", "blockquote", "caption", "center", "dd", "details", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "legend", "li", "p", "pre", "summary", "tfoot", "thead", "tr"}
#: Elements, and names in class, id or role, that mark what isn't the article. A name of several parts counts if all are listed. A container
#: is set aside by name only if it holds no more than half of the page's words and is part of the host's template (or the page is judged alone), and what is article or main within it stays.
ASIDE = {"aside", "button", "dialog", "fieldset", "footer", "form", "head", "math", "menu", "nav", "noscript", "object", "select", "svg", "template"}
HINTS = {
    "ad", "ads", "adv", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "disqus", "footer", "form", "gdpr", "login", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promotion", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Those that count within an article or main too, where the others may be the author's.
LOUD = {"ad", "ads", "adv", "advert", "advertisement", "comment", "comments", "cookie", "cookies", "disqus", "gdpr", "newsletter", "promo", "promotion", "related", "replies", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe"}
KEPT_TOP = {"article", "main"}


def is_named(token: str) -> bool:
    """Whether a container's token is that of an article or main."""
    return token.rpartition(">")[2].split(".")[0] in KEPT_TOP


class Page:
    """containers: (token, parent, place); blocks: (container, text) outside of what is set aside."""

    def __init__(self, html: str):
        self.containers: list[tuple[str, int, int]] = [("", -1, 0)]
        self.blocks: list[tuple[int, str]] = []
        self.order: list[int] = []  # containers (from 1) and blocks (-1 - number) as they come
        self.hinted: set[int] = set()  # containers whose name speaks against them
        self._read(html)

    def _read(self, html: str) -> None:
        stack, text = [(0, "")], []
        opened: Counter = Counter()  # names on the stack
        aside = depth = 0  # the element that is set aside, and how deep its own name nests in it
        at, end = 0, len(html)

        def flush() -> None:
            joined = " ".join(references.unescape("".join(text)).split())
            text.clear()
            if joined:
                self.order.append(-1 - len(self.blocks))
                self.blocks.append((stack[-1][0], joined))

        while at < end:
            m = _TAG.search(html, at)
            if m is None:
                if not aside:
                    text.append(html[at:])
                break
            if not aside:
                text.append(html[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if not m[1]:
                if name in RAW and not m[0].endswith("/>"):
                    close = re.compile(rf"(?i)</{name}(?=[\s/>])|\Z").search(html, at)
                    at = html.find(">", close.start()) + 1 if close[0] else end
                    continue
                if aside:
                    if name == aside:
                        depth += 1
                    elif name in KEPT_TOP and aside not in KEPT_TOP or aside == "p" and name in BLOCKS:
                        aside = depth = 0  # what was set aside was never closed
                    if aside:
                        continue
                if name in BLOCKS:
                    flush()
                if name in VOID:
                    text.append(" " if name == "br" else "")
                    continue
                marks = {k.lower(): (a or b or c or "") for k, a, b, c in _NAMED.findall(m[3])} if m[3] else {}
                inside = any(opened[n] for n in KEPT_TOP)
                if (name in ASIDE or name == "header" and not inside) and not m[0].endswith("/>"):
                    self._open(stack, name, marks, m.start())
                    flush()
                    stack.pop()
                    aside, depth = name, 1
                    continue
                if name in CONTAINERS:
                    self._open(stack, name, marks, m.start())
                    opened[name] += 1
                    if name not in ("html", "body", "article", "main") and any((LOUD if inside else HINTS).issuperset(filter(None, _PARTS.split(w))) and _PARTS.sub("", w) for v in marks.values() for w in v.lower().split()):
                        self.hinted.add(stack[-1][0])
            else:
                if aside:
                    if name == aside:
                        depth -= 1
                        aside = aside if depth else 0
                    elif name in ("body", "html"):
                        aside = depth = 0
                    continue
                if name in BLOCKS:
                    flush()
                if name in CONTAINERS and opened[name]:
                    last = ""
                    while last != name:
                        last = stack.pop()[1]
                        opened[last] -= 1
        flush()

    def _open(self, stack: list[tuple[int, str]], name: str, marks: dict[str, str], place: int) -> None:
        parent = stack[-1][0]
        token = f"{self.containers[parent][0]}>{name}" + "".join(f".{w}" for w in sorted(marks.get("class", "").lower().split()))
        if len(token) > 160:
            token = hashlib.blake2b(token.encode("utf-8", "replace"), digest_size=12).hexdigest() + f">{name}"
        self.order.append(len(self.containers))
        self.containers.append((token, parent, place))
        stack.append((len(self.containers) - 1, name))

    def set_aside(self, known: frozenset[int] | set[int]) -> None:
        """Drop the blocks of ``known`` containers that hold a minor share, and all within them but an article; all stay if nothing else would."""
        if not known:
            return
        words = self.held()
        gone = [False] * len(words)
        for c in range(1, len(words)):
            token, parent, _ = self.containers[c]
            gone[c] = gone[parent] and not is_named(token) or c in known and 2 * words[c] <= words[0]
        self.blocks = [b for b in self.blocks if not gone[b[0]]] or self.blocks

    def keys(self, host: str) -> tuple[list[int], list[int]]:
        """The token of each container (but the page itself) and of each block, as numbers that are the host's own."""
        number = lambda c, text: xxhash.xxh64_intdigest(f"{host}\0{self.containers[c][0]}\0{text}".encode("utf-8", "replace")) - (1 << 63)
        return [number(c, "") for c in range(1, len(self.containers))], [number(c, text) for c, text in self.blocks]

    def held(self) -> list[int]:
        """Words in each container and all within it."""
        words = [0] * len(self.containers)
        for c, text in self.blocks:
            words[c] += text.count(" ") + 1
        for c in range(len(words) - 1, 0, -1):
            words[self.containers[c][1]] += words[c]
        return words

    def alone(self) -> int:
        """The main container, judged by this page only."""
        self.set_aside(self.hinted)
        words = self.held()
        named = [c for c, (token, _, _) in enumerate(self.containers) if is_named(token) and words[c]]
        if named:
            return max(named, key=lambda c: (words[c], -c))
        return max((c for c in range(len(words)) if words[c] == words[0]), default=0)

    def within(self, main: int) -> Iterator[tuple[int, str]]:
        """Blocks of a container and of all within it."""
        inside = [False] * len(self.containers)
        for c in range(main, len(inside)):
            inside[c] = c == main or inside[self.containers[c][1]] if c else c == main
        return ((c, text) for c, text in self.blocks if inside[c])


class Template:
    """What is known of a host: the class of each frequent token (-1: none that is valid by its counts), and then the main container."""

    def __init__(self, keys: list[int], classes: list[int], main: int | None = None, bad: list[int] | None = None):
        self.of = dict(zip(keys, classes, strict=True))
        self.main, self.bad = main, {-1, *(bad or ())}

    def fixed(self, keys: list[int]) -> list[bool]:
        return [self.of.get(k, -1) not in self.bad for k in keys]


def named_aside(page: Page, containers: list[int], known: dict[int, int]) -> set[int]:
    """Containers that are named as no part of the article and belong to the host's template."""
    return {c for c in page.hinted if containers[c - 1] in known}


def text_of(html: str, host: str = "", template: Template | None = None) -> str:
    """The page's text: the blocks of its main container that aren't the template's own, one to a line."""
    page = Page(html)
    blocks = None
    if template and template.main is not None:
        containers, own = page.keys(host)
        if template.main in containers:
            main = 1 + containers.index(template.main)
            given, free = page.blocks, is_named(page.containers[main][0])
            fixed = {id(b) for b, f in zip(given, template.fixed(own), strict=True) if f and not (free and b[0] == main)}
            page.set_aside(named_aside(page, containers, template.of))
            page.blocks = [b for b in page.blocks if id(b) not in fixed]
            blocks = list(page.within(main))
            if not blocks:
                page.blocks = given
    if not blocks:
        blocks = list(page.within(page.alone()))
    return "\n".join(text for _, text in blocks)


class Counts:
    """Counters of some hosts' tokens; passed on when there are many."""

    def __init__(self) -> None:
        self.hosts: dict[str, tuple[list[int], dict[int, list[int]]]] = {}
        self.held = 0

    def add(self, host: str, keys: list[tuple[int, int]], mark: int, total: int) -> None:
        """The tokens of a page as (key, words) in order."""
        pages, tokens = self.hosts.setdefault(host, ([0], {}))
        pages[0] += 1
        before = len(tokens)
        first: dict[int, list[int]] = {}
        for place, (key, words) in enumerate(keys):
            got = first.setdefault(key, [0, place, words])
            got[0] += 1
        for key, (times, place, words) in first.items():
            got = tokens.setdefault(key, [0, 0, 0, 0, 0, 0])
            for i, x in enumerate((1, times, times * mark, place, times * words, total)):
                got[i] += x
        self.held += len(tokens) - before


def page_tokens(page: Page, host: str) -> list[tuple[int, int]]:
    """(key, words; 0 for containers) of a page's tokens as they come."""
    containers, blocks = page.keys(host)
    return [(containers[x - 1], 0) if x > 0 else (blocks[-1 - x], page.blocks[-1 - x][1].count(" ") + 1) for x in page.order]


def by_host(batches: Iterator[pa.RecordBatch], keep) -> Iterator[Counts]:
    """Counters of the tokens that ``keep`` (a test, or None for all) lets through."""
    counts = Counts()
    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(html)
            tokens = page_tokens(page, host)
            total = sum(words for _, words in tokens)
            mark = int.from_bytes(hashlib.blake2b(html.encode("utf-8", "replace"), digest_size=4).digest(), "big")
            counts.add(host, [t for t in tokens if keep is None or keep(t[0])], mark, total)
            if counts.held >= HELD_TOKENS:
                yield counts
                counts = Counts()
    yield counts


def frequent(pages: DataFrame) -> DataFrame:
    """(key): tokens in half of the pages of a host that some task has seen; every token of half of all its pages is among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("op2")
        for counts in by_host(batches, None):
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for n, tokens in counts.hosts.values() for k, got in tokens.items() if 2 * got[0] >= n[0]], pa.int64())})

    return pages.select("host", "html").mapInArrow(run, "key long").distinct()


def counted(pages: DataFrame, hosts: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, all_pages, key, pages, times, vector, place, words, total): exact sums over all pages of tokens in half of a host's pages."""
    flags = flags_of(scratch.table(frequent(pages), "frequent"), "key")
    names = ("pages", "times", "vector", "place", "words", "total")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("op2")
        known = flags.value
        for counts in by_host(batches, lambda key: flagged(known, key)):
            rows = [(host, key, *got) for host, (_, tokens) in counts.hosts.items() for key, got in tokens.items()]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i, n in enumerate(("host", "key", *names))})

    sums = pages.select("host", "html").mapInArrow(run, "host string, key long, " + ", ".join(f"{n} long" for n in names))
    sums = sums.groupBy("host", "key").agg(*(F.sum(F.col(n).cast("decimal(38,0)") if n == "vector" else F.col(n)).alias(n) for n in names))
    often = sums.join(hosts, "host").where((F.col("all_pages") >= LEAST_PAGES) & (2 * F.col("pages") >= F.col("all_pages")))
    return often.withColumn("vector", F.col("vector").cast("string"))


def classes_of(rows: list[dict]) -> list[tuple[int, int]]:
    """(key, class) of one host's frequent tokens by their counts: class 0 is that of all pages, -1 none. Tokens of a class come in order of place."""
    by: dict[tuple, list[dict]] = {}
    for r in rows:
        by.setdefault((r["pages"], r["times"], r["vector"]), []).append(r)
    out: list[tuple[int, int]] = []
    number = 0
    for (pages, times, _), tokens in sorted(by.items(), reverse=True):
        every = pages == times == tokens[0]["all_pages"]
        minor = 2 * sum(r["words"] for r in tokens) <= tokens[0]["total"]
        valid = every or len(tokens) > 1 and minor
        number += valid and not every
        out += [(r["key"], 0 if every else number if valid else -1) for r in sorted(tokens, key=lambda r: (r["place"], r["key"]))]
    return out


def built(often: DataFrame) -> DataFrame:
    """(host, keys, classes, once): tokens by class in order of place; whether each comes once a page. No more rows a host than two pages have tokens."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        single = {r["key"]: r["pages"] == r["times"] for r in rows}
        got = classes_of(rows)
        columns = {"host": [key[0].as_py()], "keys": pa.array([[k for k, _ in got]], pa.list_(pa.int64())), "classes": pa.array([[c for _, c in got]], pa.list_(pa.int32())), "once": pa.array([[single[k] for k, _ in got]], pa.list_(pa.bool_()))}
        return pa.table(columns)

    return often.groupBy("host").applyInArrow(build, "host string, keys array<long>, classes array<int>, once array<boolean>")


def misplaced(place: dict[int, int], runs: dict[int, list[int]]) -> set[int]:
    """Classes (once a page, with their tokens in order) that break order or nesting in a page, given the places of its tokens."""
    bad = set()
    spots: dict[int, list[int]] = {}
    for c, keys in runs.items():
        at = [place[k] for k in keys if k in place]
        if at != sorted(at):
            bad.add(c)
        elif at:
            spots[c] = at
    order = sorted(spots)  # frequent classes first
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = spots[a], spots[b]
            if bisect(x, y[0]) != bisect(x, y[-1]) and bisect(y, x[0]) != bisect(y, x[-1]):
                bad.add(b)
    return bad


def slots(page: Page, host: str, template: Template) -> Iterator[tuple[int, int, int, int, int]]:
    """(container key, class of the text, words within, words outside, depth) of a page's template containers; class -1 is what no class fixes."""
    containers, own = page.keys(host)
    page_blocks = page.blocks
    class_of = {id(b): template.of.get(k, -1) for b, k in zip(page_blocks, own, strict=True)}
    page.set_aside(named_aside(page, containers, template.of))
    words: dict[int, list[int]] = {}
    for b in page.blocks:
        words.setdefault(class_of[id(b)], [0] * len(page.containers))[b[0]] += b[1].count(" ") + 1
    times = Counter(containers)
    depth = [0] * len(page.containers)
    for c in range(1, len(depth)):
        depth[c] = depth[page.containers[c][1]] + 1
    for cls, sums in words.items():
        for c in range(len(sums) - 1, 0, -1):
            sums[page.containers[c][1]] += sums[c]
        for c in range(1, len(sums)):
            if times[containers[c - 1]] == 1 and containers[c - 1] in template.of:
                yield containers[c - 1], cls, sums[c], sums[0] - sums[c], 2 * depth[c] + is_named(page.containers[c][0])
        yield 0, cls, sums[0], 0, 0


def fitted(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(host, main, bad): the main container's token and the classes that are out of order somewhere or don't nest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("op2")
        sums: dict[tuple[str, int, int], list[int]] = {}
        seen: dict[str, tuple[Template, dict[int, list[int]]]] = {}
        for batch in batches:
            for host, html, keys, classes, once in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if host not in seen:
                    runs: dict[int, list[int]] = {}
                    for k, c, single in zip(keys, classes, once, strict=True):
                        if c >= 0 and single:
                            runs.setdefault(c, []).append(k)
                    seen[host] = Template(keys, classes), runs
                template, runs = seen[host]
                page = Page(html)
                place = {key: i for i, (key, _) in enumerate(page_tokens(page, host))}
                for c in misplaced(place, runs):
                    sums.setdefault((host, 0, -2 - c), [0, 0, 0, 0])
                for key, cls, inside, outside, depth in slots(page, host, template):
                    got = sums.setdefault((host, key, cls), [0, 0, 0, 0])
                    for i, x in enumerate((inside, outside, depth, 1)):
                        got[i] += x
            if len(sums) >= HELD_TOKENS or len(seen) >= HELD_TOKENS // 100:
                yield table(sums)
                sums, seen = {}, {}
        yield table(sums)

    def table(sums: dict) -> pa.RecordBatch:
        names = ("host", "key", "class", "inside", "outside", "depth", "pages")
        flat = [(*k, *v) for k, v in sums.items()]
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in flat], pa.string() if i == 0 else pa.int64()) for i, n in enumerate(names)})

    pages = rows.where("html is not null").join(known, "host").select("host", "html", "keys", "classes", "once")
    measured = pages.mapInArrow(run, "host string, key long, class long, inside long, outside long, depth long, pages long")
    total = measured.groupBy("host", "key", "class").agg(*(F.sum(c).alias(c) for c in ("inside", "outside", "depth", "pages")))

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bad = sorted({-2 - r["class"] for r in rows if r["class"] < -1})
        return pa.table({"host": [key[0].as_py()], "main": pa.array([main_of(rows, {-1, *bad})], pa.int64()), "bad": pa.array([bad], pa.list_(pa.int32()))})

    return total.groupBy("host").applyInArrow(choose, "host string, main long, bad array<int>")


def main_of(rows: list[dict], open_classes: set[int]) -> int | None:
    """The container of most text in slots that is an article or main, else the deepest that leaves none outside."""
    found: dict[int, list[int]] = {}
    every = 0
    for r in rows:
        if r["class"] in open_classes:
            if r["key"] == 0:
                every += r["inside"]
                continue
            got = found.setdefault(r["key"], [0, 0, 0])
            for i, n in enumerate(("inside", "outside")):
                got[i] += r[n]
            got[2] = max(got[2], r["depth"] // max(1, r["pages"]))
    named = [(inside, depth, key) for key, (inside, _, depth) in found.items() if depth % 2 and inside]
    if named:
        return max(named)[2]
    whole = [(depth, key) for key, (inside, _, depth) in found.items() if inside and inside == every]
    return max(whole)[1] if whole else None


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def templates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, keys, classes, main, bad) of every host with enough pages."""
    pages = rows.where("html is not null").select("host", "html")
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("all_pages"))
    known = scratch.table(built(counted(pages, hosts, scratch)), "classes")
    main = scratch.table(fitted(rows, known), "main")
    return scratch.table(known.join(main, "host").select("host", "keys", "classes", "main", "bad"), "templates")


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    The templates are a small written table, one row for each host with enough pages: Spark broadcasts it if its size allows, and
    otherwise joins by host, where large hosts can be split.
    """
    spark = prepare(pages.sparkSession)
    scratch = Scratch(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    known = templates(rows, scratch)
    scratch.clear("templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("op2")
        held: dict[str, Template] = {}
        for batch in batches:
            texts = []
            for html, host, keys, classes, main, bad in zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True):
                if keys is not None and host not in held:
                    if len(held) >= HELD_TOKENS // 100:
                        held.clear()
                    held[host] = Template(keys, classes, main, bad)
                texts.append(text_of(html or "", host, held[host] if keys is not None else None))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return rows.join(known, "host", "left").select("page_id", "url", "html", "host", "keys", "classes", "main", "bad").mapInArrow(run, "page_id long, url string, text string, n_chars long")
