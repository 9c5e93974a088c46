"""Main text of pages by nearest-URL page differencing.

Pages of a host are ordered by URL path. A page is compared with the nearest pages on either side that are no copies
of it: their text lines are aligned by longest common subsequence, and shared lines, the site's frame, are deleted. A
line counts as frame if both neighbours have it, or if the nearer one has it and it stands at the page's head or
tail; a neighbour that shares most of the rest too is a near copy and decides nothing alone. What the
markup itself declares as frame (navigation, footers, adverts, forms) goes as well, and what it declares as the
article stays, so that quotations and reprinted paragraphs are not lost.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetone.session import cut_lineage

#: Share of a page's lines above which a single neighbour is a near copy.
NEAR_COPY = 0.8
FRAME, PLAIN, ARTICLE = 0, 1, 2
GUESSED = 3  # frame by the name of a class or id only: an article inside lifts it

# Elements without text of their own, elements of a page's frame, of an article, and blocks.
_SKIPPED = {"script", "style", "noscript", "template", "svg", "head", "iframe", "object", "canvas", "math", "textarea",
            "select", "option", "button", "title"}
_RAW = {"script", "style", "textarea", "noscript", "iframe", "template", "title"}
_IN_HEAD = {"title", "meta", "link", "base", "basefont", "bgsound", "script", "style", "noscript", "template"}
_FRAME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_ARTICLE = {"article", "main"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
           "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
           "var", "wbr", "ruby", "rt", "rp"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure",
           "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre",
           "search", "section", "summary", "table", "ul"}
# Words of class names and ids: those of a frame, and those that say nothing by themselves. A name is frame if all its words
# are of these and one of the first.
_FRAME_WORDS = set("""nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts
    advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice newsletter subscribe signup
    login comment comments respond disqus share sharing social related recommended popup modal toolbar pagination pager widget
    search""".split())
_LAYOUT_WORDS = set("""site page main global top bottom left right upper lower primary secondary first second big small box block wrap wrapper container
    inner outer area section bar list links link item items row column col buttons button icons icon posts post articles article stories
    story form panel group unit slot side js desktop mobile fixed sticky""".split())
_FRAME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                     r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


def _is_frame_name(name: str) -> bool:
    words = [w for w in re.split(r"[_-]+", name.lower()) if w]
    return any(w in _FRAME_WORDS for w in words) and all(w in _FRAME_WORDS or w in _LAYOUT_WORDS or w.isdigit() for w in words)


def _declared(name: str, attributes: str, inside_article: bool) -> int | None:
    if name in _FRAME:
        # the heading of an article may sit in a header of its own
        return PLAIN if name == "header" and inside_article else FRAME
    role, guessed = None, False
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            value = value.strip("\"'")
            key = key.lower()
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return FRAME
            if key == "role":
                role = value.lower()
            if key in ("class", "id") and name not in ("body", "html", "article", "main"):
                guessed = guessed or any(_is_frame_name(w) for w in value.split())
    if role in _FRAME_ROLES:
        return FRAME
    if role in ("main", "article") or name in _ARTICLE:
        return ARTICLE
    return GUESSED if guessed else None


def text_lines(html: str | None) -> list[tuple[str, int]]:
    """(line, role) of every text block in page order; white space within a block is one space."""
    page = html or ""
    lines: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open elements that matter: name, role before it, was it skipped before
    role, skipped = PLAIN, False

    def close_block() -> None:
        if buffer:
            line = " ".join(entities.unescape("".join(buffer)).split())
            if line:
                lines.append((line, FRAME if role == GUESSED else role))
            buffer.clear()

    at, size = 0, len(page)
    while at < size:
        found = _MARKUP.search(page, at)
        if not skipped and (found is None or found.start() > at):
            buffer.append(page[at:found.start() if found else size])
        if found is None:
            break
        at = found.end()
        if found[2] is None:
            if found[0].startswith("<![CDATA[") and not skipped:
                buffer.append(found[0][9:].removesuffix("]]>"))
            continue
        name = found[2].lower()
        if found[1]:
            if name not in _INLINE:
                close_block()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close_block()
                    role, skipped = stack[k][1], stack[k][2]
                    del stack[k:]
                    break
            continue
        if name not in _INLINE and name not in _RAW:
            close_block()
        # A head or a paragraph that is left open ends where something begins that it cannot hold.
        opened = -1
        if skipped and name not in _IN_HEAD and name != "head":
            opened = next((k for k, x in enumerate(stack) if x[0] == "head"), -1)
        if opened < 0 and name in _ENDS_P:
            opened = len(stack) - 1
            while opened >= 0 and stack[opened][0] in _INLINE:
                opened -= 1
            if opened >= 0 and stack[opened][0] != "p":
                opened = -1
        if opened >= 0:
            close_block()
            role, skipped = stack[opened][1], stack[opened][2]
            del stack[opened:]
        if name in _VOID or found[0].endswith("/>"):
            continue
        if name in _CLOSES and stack and stack[-1][0] in _CLOSES[name]:
            close_block()
            _, role, skipped = stack.pop()
        new_role = FRAME if role == FRAME else _declared(name, found[3], role == ARTICLE)
        if role == GUESSED and new_role not in (FRAME, ARTICLE):
            new_role = GUESSED
        if name in _RAW:  # nothing in it is markup
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in _SKIPPED or new_role is not None or name in ("div", "section", "ul", "ol", "table", *_CLOSES):
            if new_role is not None and new_role != role:
                close_block()
            stack.append((name, role, skipped))
            skipped = skipped or name in _SKIPPED
            role = new_role if new_role is not None and not (role == ARTICLE and new_role == PLAIN) else role
    close_block()
    return lines


def _line_hash(line: str) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))).astype(np.int64))


def shared_lines(own: np.ndarray, other: np.ndarray) -> list[int]:
    """Positions in ``own`` of a longest common subsequence with ``other``.

    Common ends are matched first. The rest goes through matching positions only, in O(matches log n) time
    and memory in proportion to them, so long pages do not need a square table.
    """
    n, m = len(own), len(other)
    a = 0
    while a < min(n, m) and own[a] == other[a]:
        a += 1
    b = 0
    while b < min(n, m) - a and own[n - 1 - b] == other[m - 1 - b]:
        b += 1
    places: dict[int, list[int]] = {}
    for j in range(m - b - 1, a - 1, -1):  # descending: a line matches at most once in each subsequence
        places.setdefault(int(other[j]), []).append(j)
    from bisect import bisect_left

    ends: list[int] = []
    last: list[int] = []
    links: list[tuple[int, int]] = []  # (position in own, previous link)
    for i in range(a, n - b):
        for j in places.get(int(own[i]), ()):
            k = bisect_left(ends, j)
            links.append((i, last[k - 1] if k else -1))
            if k == len(ends):
                ends.append(j)
                last.append(len(links) - 1)
            else:
                ends[k] = j
                last[k] = len(links) - 1
    middle, k = [], last[-1] if last else -1
    while k >= 0:
        middle.append(links[k][0])
        k = links[k][1]
    return [*range(a), *middle[::-1], *range(n - b, n)]


def _common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def _ends(gone: list[int], n: int) -> set[int]:
    """Those of the positions that are a page's head or tail, without a line between."""
    shared, head, tail = set(gone), 0, n
    while head in shared:
        head += 1
    while tail - 1 in shared and tail > head:
        tail -= 1
    return set(range(head)) | set(range(tail, n))


def frame_of(own: np.ndarray, near: np.ndarray | None, far: np.ndarray | None) -> list[int]:
    """Positions of the frame lines of a page with a nearer and a farther neighbour (see the module's text)."""
    if near is None:
        return []
    with_near = shared_lines(own, near)
    with_far = [] if far is None else shared_lines(own, far)
    if not with_far:  # one neighbour, or one of another kind: a page that is almost wholly shared has a near copy beside it
        return sorted(_ends(with_near, len(own))) if len(with_near) <= NEAR_COPY * len(own) else []
    both = set(with_near) & set(with_far)
    rest, more = len(own) - len(both), [k for k in with_near if k not in both]
    return sorted(both | (_ends(with_near, len(own)) if len(more) <= rest / 2 else set()))


def _pair(rows: list[tuple], at: int) -> list[int]:
    """Frame positions of row ``at``, by its neighbours of the same host."""
    host, path, own = rows[at][0], rows[at][1], rows[at][3]
    near = sorted((-_common_prefix(path, rows[k][1]), k) for k in (at - 1, at + 1) if 0 <= k < len(rows) and rows[k][0] == host)
    return frame_of(own, *[rows[k][3] for _, k in near], *[None] * (2 - len(near)))


def frame_lines(keyed: DataFrame) -> DataFrame:
    """(page, gone): positions of the lines that are a page's frame.

    ``keyed`` has page (bigint), host, path and lines (array of line hashes). Rows are ordered by ranges of
    (host, path, page), so a large host is dealt over many tasks. Rows next to each other with equal lines are one
    run, however long: its first row is compared with the runs on either side, for all of them. The runs next to
    a range's border are joined or handed over, so the result does not depend on the ranges.
    """
    spark = keyed.sparkSession
    order = ["host", "path", "page"]

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, head = None, None
        for batch in batches:
            heads = []
            for host, page, same in zip(batch["host"], batch["page"], batch["same"], strict=True):
                if (host, same) != last:
                    last, head = (host, same), page
                heads.append(head)
            batch["head"] = pd.Series(heads, index=batch.index, dtype="int64")
            batch["lines"] = batch["lines"].where(batch["head"] == batch["page"], None)
            yield batch

    ranged = cut_lineage(keyed.repartitionByRange(*order).sortWithinPartitions(*order)
                         .select(*order, F.spark_partition_id().alias("range"), F.xxhash64("lines").alias("same"), "lines")
                         .mapInPandas(runs, "host string, path string, page bigint, range int, same bigint, lines array<bigint>, head bigint"))
    heads = ranged.filter("head = page")

    def borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last = [], []
        for batch in batches:
            rows = list(batch.itertuples(index=False, name=None))
            first += rows[:max(0, 2 - len(first))]
            last = rows[-1:] or last
        yield pd.DataFrame([(*r, side) for side, rows in (("first", first), ("last", last)) for r in rows],
                           columns=["range", *order, "same", "side"])

    # At most three keys per task come to the driver; their lines stay on the executors.
    found: dict[int, dict[str, list[tuple]]] = {}
    for r in heads.select("range", *order, "same").mapInPandas(
            borders, "range int, host string, path string, page bigint, same bigint, side string").collect():
        found.setdefault(r["range"], {"first": [], "last": []})[r["side"]].append((r["host"], r["path"], r["page"], r["same"]))
    ranges = sorted(found)
    joined, ends, run = [], [], None  # a range's first run may go on from the range before
    for here in ranges:
        first, last = found[here]["first"], found[here]["last"][0]
        if run and (run[0], run[3]) == (first[0][0], first[0][3]):
            joined.append((first[0][2], run[2]))
            own = None if last == first[0] else last
            first = first[1:]
        else:
            own = last
        run = own or run
        ends.append((here, first[0] if first else None, own))
    copies = []
    before = None
    for here, _, own in ends:
        if before:
            copies.append((here, *before[:3]))
        before = own or before
    after = None
    for here, first, _ in reversed(ends):
        if after:
            copies.append((here, *after[:3]))
        after = first or after
    to = spark.createDataFrame(joined, "was bigint, to bigint")
    heads = heads.join(F.broadcast(to), heads["page"] == to["was"], "left_anti")
    own = heads.select(*order, "lines", "range", F.lit(False).alias("guest"))
    if copies:
        wanted = spark.createDataFrame(copies, "to int, host string, path string, page bigint")
        guests = (heads.alias("r").join(F.broadcast(wanted).alias("w"),
                                        F.expr("r.host <=> w.host and r.path <=> w.path and r.page = w.page"))
                  .select(F.col("r.host"), F.col("r.path"), F.col("r.page"), F.col("r.lines"),
                          F.col("w.to").alias("range"), F.lit(True).alias("guest")))
        own = own.unionByName(guests)
    together = own.repartition(max(1, len(ranges)), "range").sortWithinPartitions("range", *order)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window: list[tuple] = []
        todo = 0

        def ready(upto: int) -> pd.DataFrame:
            rows = [(window[k][2], _pair(window, k)) for k in range(todo, upto) if not window[k][4]]
            return pd.DataFrame({"head": pd.Series([r[0] for r in rows], dtype="int64"),
                                 "gone": pd.Series([r[1] for r in rows], dtype=object)})

        for batch in batches:
            window += [((r, h), p or "", k, np.asarray(x, dtype=np.int64), g) for r, h, p, k, x, g in zip(
                batch["range"], batch["host"], batch["path"], batch["page"], batch["lines"], batch["guest"], strict=True)]
            upto = max(todo, len(window) - 1)
            yield ready(upto)
            drop = max(0, upto - 1)
            window, todo = window[drop:], upto - drop
        yield ready(len(window))

    gone = together.mapInPandas(compare, "head bigint, gone array<int>")
    return (ranged.join(F.broadcast(to), ranged["head"] == to["was"], "left")
            .select("page", F.coalesce("to", "head").alias("head")).join(gone, "head").select("page", "gone"))


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars): the main text of every row, blocks joined by one line feed.

    Null html is an empty page with empty text; a null url belongs to no host and is compared with no page.
    Equal rows give equal texts, one row each. Pages without a neighbour keep what their markup does not call
    frame. No rows give no rows. Pages are shuffled once, as parsed lines; only line hashes are sorted by URL.
    """
    schema = "page bigint, key bigint, url string, texts array<string>, at array<int>, article array<boolean>, lines array<bigint>"
    slim = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"))
    slim = slim.withColumn("page", F.xxhash64("key", "url", "html"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.iloc[a:a + 500]
                found = [text_lines(h) for h in part["html"]]
                kept = [[(k, t, r == ARTICLE) for k, (t, r) in enumerate(f) if r != FRAME] for f in found]
                yield pd.DataFrame({
                    "page": part["page"].to_numpy(), "key": pd.array(part["key"], dtype="Int64"), "url": part["url"].to_numpy(),
                    "texts": [[t for _, t, _ in f] for f in kept], "at": [[k for k, _, _ in f] for f in kept],
                    "article": [[x for _, _, x in f] for f in kept], "lines": [[_line_hash(t) for t, _ in f] for f in found]})

    parsed = slim.mapInPandas(parse, schema)
    bare = F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/]*)", 1))
    hashes = (parsed.filter(F.col("url").isNotNull() & (host != ""))
              .select("page", host.alias("host"), F.regexp_replace(bare, r"^[^/]*", "").alias("path"), "lines").distinct())
    joined = parsed.drop("lines").join(frame_lines(hashes), "page", "left")
    kept = F.filter(F.arrays_zip("texts", "at", "article"),
                    lambda x: x["article"] | ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), x["at"]))
    text = F.array_join(F.transform(kept, lambda x: x["texts"]), "\n")
    return joined.select(F.col("key").alias(key), F.col("url").alias(url), text.alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("bigint"))
