"""Main text of web pages by nearest-URL page differencing.

1. A page is cut into text lines, one for each block: tags, comments, scripts and styles go, character
   references are decoded, white space becomes single spaces. Every line knows where it stood: inside
   an element that is no content (menu, header, footer, sidebar, form, notice, advert, comments, by
   element or by the words of its class, id and role), or in which content element.
2. Pages of a host are sorted by URL path. A page is paired with the nearest one on either side. The
   lines of a pair are aligned by a longest common subsequence; lines in it are the site's template
   and are deleted from both. A neighbour that shares most characters of both pages' content is a copy of the
   page, not a template of it, and is no evidence: the page is then paired with the nearest earlier page that
   is no copy of that neighbour.
3. Lines inside an element that says it is content (article, else main, else one named so) are never
   deleted by differencing, because passages that articles share are still articles. What else stands outside such an
   element goes by its structure. Pages without one have differencing and the elements without content only.

n_shared counts the lines that differencing deletes, n_other those that only structure shows to be no text.

Sorting is a range partition of hashes only; pairs across two partitions are made from the first and
last row of each, so no host is ever gathered in one task. Only which earlier page replaces a copy depends on
where partitions end.

Null html: empty text. A null or odd url: no host, paired with other such pages. Equal rows get equal
results. Pages of any length are read whole; an empty table gives an empty result. Further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Iterator
from math import isqrt
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconcilia.llm.common import saved

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var del br wbr img input td th".split())
CHROME = frozenset("nav header footer aside form dialog menu button fieldset".split())
#: Words of class, id or role that name an element without content.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar sidebars widget widgets complementary contentinfo "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog paywall disclaimer "
    "newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus reply replies respond "
    "related recommended recommendations pagination pager toolbar skip search hidden copyright".split()
)
READER_WORDS = frozenset("comment comments reply replies related recommended".split())
#: Words that take the meaning of the one that follows: has-sidebar, no-comments.
MODIFIERS = frozenset("has with no without".split())
CONTENT_WORDS = frozenset("article content post entry story main".split())
#: An opening tag of these closes an open element of the same kind.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table body article main div section".split())


def _nature(tag: str, attributes: str, inside: int) -> tuple[bool, int]:
    """Whether an element is no content, and the rank of content element that it is (0 to 3)."""
    words: set[str] = set()
    role = ""
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id", "role"):
                found = NAME_WORD.findall(value)
                words.update(w for before, w in zip(["", *found], found, strict=False) if before not in MODIFIERS)
                role = value if name == "role" else role
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, 0
    if tag in ("html", "body"):
        return False, 0
    if tag == "header" and inside == 3:  # an article's own head holds its title
        return False, 0
    named = tag in ("article", "main") and words & CONTENT_WORDS and not words & READER_WORDS  # a sponsored post is a post
    if tag in CHROME or words & CHROME_WORDS and not named or "header" in words and not inside:
        return True, 0
    return False, 3 if tag == "article" else 2 if tag == "main" or role == "main" else 1 if words & CONTENT_WORDS else 0


class OpenElements:
    """The elements that are open at a place of a page (tag, no content, rank), and where each tag stands among them."""

    def __init__(self) -> None:
        self.all: list[tuple[str, bool, int]] = [("", False, 0)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.lists: list[int] = []

    @property
    def last(self) -> tuple[str, bool, int]:
        return self.all[-1]

    def open(self, tag: str, chrome: bool, rank: int) -> None:
        for places in (self.places[tag], *([self.lists] if tag in LISTS else ())):
            places.append(len(self.all))
        self.all.append((tag, chrome, rank))

    def place(self, tag: str) -> int:
        """Where the innermost element of a tag stands; -1 if none is open."""
        return self.places[tag][-1] if self.places.get(tag) else -1

    def place_of_list(self) -> int:
        return self.lists[-1] if self.lists else -1

    def cut(self, depth: int) -> None:
        """Ends the element at a place and all inside it."""
        while len(self.all) > depth:
            tag, _, _ = self.all.pop()
            self.places[tag].pop()
            if tag in LISTS:
                self.lists.pop()


def page_lines(page: str | None) -> tuple[list[str], list[int]]:
    """Lines of a page and where each stood: -1 no content, else the rank of its content element."""
    lines: list[str] = []
    ranks: list[int] = []
    held: list[str] = []
    stack = OpenElements()
    page, at = page or "", 0

    def flush() -> None:
        if held:
            line = " ".join("".join(held).split())
            if line:
                lines.append(line)
                _, chrome, rank = stack.last
                ranks.append(-1 if chrome else rank)
            held.clear()

    while at < len(page):
        found = TAG.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            held.append(references.unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        attributes = found[3] or found[6] or ""
        if tag in INLINE or tag in VOID:
            if tag in ("br", "td", "th", "img", "input"):
                held.append(" ")
            elif tag == "hr":
                flush()
            if tag not in VOID and attributes and not (found[1] or found[4]):
                chrome, _ = _nature(tag, attributes, stack.last[2])
                if chrome:
                    flush()
                    stack.open(tag, True, 0)
            elif (found[1] or found[4]) and stack.last[0] == tag:
                flush()
                stack.cut(stack.place(tag))
            continue
        if tag in RAW and not (found[1] or found[4]):  # these stand inside a block and don't end it
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        flush()
        if found[1] or found[4]:
            depth = stack.place(tag)
            if depth >= 0 and not (tag in ("p", "li") and stack.place_of_list() > depth):
                stack.cut(depth)
            continue
        while stack.last[0] == "p" and not stack.last[1]:
            stack.cut(stack.place("p"))  # a block ends an open paragraph
        sibling = max(map(stack.place, SIBLINGS.get(tag, ())), default=-1)
        if sibling > stack.place_of_list():
            stack.cut(sibling)
        _, above, rank = stack.last
        chrome, own = _nature(tag, attributes, rank)
        stack.open(tag, above or chrome, max(rank, own))
    flush()
    return lines, ranks


#: Lines that stand at more places of a page than this keep their bits; for others they are made when needed.
FEW = 8


def common_subsequence(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by bit-parallel rows.

    What both begin and end with is paired first. A row is one integer: bit j is 0 where the length grows from b[:j] to
    b[:j + 1]. Every so many rows are kept, and those between are made again on the way back, so time grows with
    len(a) * len(b) / 64 however often lines repeat, and memory with the square root of len(a) times len(b) / 8.
    """
    head, size = 0, min(len(a), len(b))
    while head < size and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < size - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(len(a) - 1 - k, len(b) - 1 - k) for k in range(tail)]
    own, other = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict[int, list[int]] = {}
    for j, v in enumerate(other):
        places.setdefault(v, []).append(j)
    masks: dict[int, int] = {}
    rows = [(i, v) for i, v in enumerate(own) if v in places]  # other lines pair with nothing
    for v in {v for _, v in rows}:
        if len(places[v]) > FEW:
            bits = bytearray(len(other) // 8 + 1)
            for j in places[v]:
                bits[j >> 3] |= 1 << (j & 7)
            masks[v] = int.from_bytes(bits, "little")
    every = (1 << len(other)) - 1

    def below(row: int, v: int) -> int:
        at = row & (masks[v] if v in masks else sum(1 << j for j in places[v]))
        return ((row + at) | (row - at)) & every

    step = max(1, isqrt(len(rows)))
    kept, row = [every], every
    for k, (_, v) in enumerate(rows, 1):
        row = below(row, v)
        if k % step == 0:
            kept.append(row)
    k, j = len(rows), len(other)
    while k and j:
        first = (k - 1) // step * step
        block = [kept[first // step]]
        for _, v in rows[first:k]:
            block.append(below(block[-1], v))
        while k > first and j:
            if block[k - first] >> (j - 1) & 1:
                j -= 1
            else:
                k -= 1
                if block[k - first] >> (j - 1) & 1:
                    j -= 1
                    out.append((head + rows[k][0], head + j))
    out += [(k, k) for k in reversed(range(head))]
    return out[::-1]


#: A neighbour that shares at least this part of the characters of both pages' content lines is a copy.
COPY = 0.8


def template_lines(a: list[int], a_body: list[int], b: list[int], b_body: list[int]) -> tuple[list[int], list[int]] | None:
    """Places of the lines that two pages share as their template; None for copies. ``_body``: characters of content lines, 0 for others."""
    shared = common_subsequence(a, b)
    body = sum(min(a_body[i], b_body[j]) for i, j in shared)
    if body and body >= COPY * max(sum(a_body), sum(b_body)):
        return None
    return [i for i, _ in shared], [j for _, j in shared]


def _where(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path.rstrip("/")
    except ValueError:
        return "", url or ""


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("hashes", pa.list_(pa.int64())), ("body", pa.list_(pa.int32()))])
    for batch in batches:
        rows = []
        for row, url, page in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            lines, ranks = page_lines(page.as_py())
            top = max(ranks, default=0)
            rows.append((row.as_py(), *_where(url.as_py()), [np.int64(np.uint64(xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))).view(np.int64)) for x in lines], [len(x) if r == top else 0 for x, r in zip(lines, ranks, strict=True)]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


PAIRED = pa.schema([("row", pa.int64()), ("shared", pa.list_(pa.int32())), ("edge", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("hashes", pa.list_(pa.int64())), ("body", pa.list_(pa.int32()))])
PAIRED_DDL = "row long, shared array<int>, edge boolean, host string, path string, hashes array<long>, body array<int>"


def _align(edges: bool):
    """Aligns neighbours of a sorted partition; with ``edges``, also hands on its first and last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, other, out = None, None, []  # the row before, and the last one of its host that is no copy of it
        for batch in batches:
            for now in batch.select(["row", "host", "path", "hashes", "body"]).to_pylist():
                if before is None:
                    if edges:
                        out.append(now | {"edge": True, "shared": None})
                elif now["host"] != before["host"]:
                    other = None
                elif now["row"] != before["row"]:
                    found, partner = template_lines(before["hashes"], before["body"], now["hashes"], now["body"]), before
                    if found is not None:
                        other = before
                    elif other is not None:
                        found, partner = template_lines(other["hashes"], other["body"], now["hashes"], now["body"]), other
                    for page, places in zip((partner, now), found or ([], []), strict=True):
                        if places:
                            out.append({"row": page["row"], "shared": places, "edge": False})
                before = now
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, PAIRED)
                out = []
        if before is not None and edges:
            out.append(before | {"edge": True, "shared": None})
        if out:
            yield pa.RecordBatch.from_pylist(out, PAIRED)

    return run


def _content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("row", pa.int64()), ("lines", pa.list_(pa.string())), ("ranks", pa.list_(pa.int32()))])
    for batch in batches:
        for start in range(0, len(batch), 1000):
            part = batch.slice(start, 1000)
            lines, ranks = [], []
            for page in part.column(3):
                found, own = page_lines(page.as_py())
                lines.append([x if r >= 0 else "" for x, r in zip(found, own, strict=True)])  # what is no content needs no text
                ranks.append(own)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(lines, pa.list_(pa.string())), pa.array(ranks, pa.list_(pa.int32()))], schema=schema)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines deleted by differencing), n_other (further lines deleted by structure) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64("page_id", "url", "html").alias("row"), F.col("html").cast("string").alias("html"))
    outline = rows.select("row", "url", "html").mapInArrow(_outline, "row long, host string, path string, hashes array<long>, body array<int>")
    order = ["host", "path", "row"]
    paired = saved(outline.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_align(True), PAIRED_DDL))
    # two rows for each partition, whatever the data
    across = paired.where("edge").repartition(1).sortWithinPartitions(*order).mapInArrow(_align(False), PAIRED_DDL)
    shared = paired.where("NOT edge").select("row", "shared").unionByName(across.select("row", "shared"))
    shared = shared.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared"))
    content = rows.mapInArrow(_content, "page_id long, url string, row long, lines array<string>, ranks array<int>")
    joined = content.join(shared, "row", "left").withColumn("top", F.greatest(F.lit(0), F.coalesce(F.array_max("ranks"), F.lit(0))))
    places = F.sequence(F.lit(0), F.size("ranks") - 1)
    guarded = lambda r: (r == F.col("top")) & (F.col("top") > 0)
    deleted = F.filter(F.coalesce("shared", F.array().cast("array<int>")), lambda i: ~guarded(F.get("ranks", i)))
    left = F.filter(F.array_except(F.when(F.size("ranks") > 0, places).otherwise(F.array().cast("array<int>")), "deleted"), lambda i: F.get("ranks", i) == F.col("top"))
    joined = joined.withColumn("deleted", deleted).withColumn("kept", left)
    text = F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")
    return joined.select(
        "page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"),
        F.size("deleted").alias("n_shared"), (F.size("ranks") - F.size("deleted") - F.size("kept")).alias("n_other"),
    )
