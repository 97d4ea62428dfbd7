"""Main text of web pages by differencing each page with the page of the nearest URL on its host.

A page becomes lines: its blocks, with references decoded and white space joined. Each page is paired with a page
of other content whose path shares the longest prefix with its own, host by host. The lines of both are aligned by
their longest common subsequence, and shared lines go: what a site repeats from page to page is not its article.
Where a page marks its article (article, main and the like), shared lines inside it go too, and so do lines outside
it even if not shared, as do marked menus, headers, footers, sidebars, adverts, notices, forms and comments. A page
that marks nothing keeps the lines that are not shared and not mostly links. In both, all lines stay if the other page
shares nearly everything (``COPY``): near copies of an article on one host would otherwise erase each other.

Null and empty pages give an empty text; a null URL has no partner. Rows with equal content never pair. Repeated
rows give equal texts; unclosed and cut-off markup is read as far as it goes; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import html as references
import re
from typing import NamedTuple

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.llm.common import arrow, stored, table

#: A page is a copy when its partner shares more than this part of the characters of its article, or of all if none is marked.
COPY = 0.8
#: Elements without text of the page; containers that never hold the article; elements that end a block.
_RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|title|select|canvas|audio|video"
_AWAY = frozenset("nav footer aside form dialog menu button head fieldset".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul caption".split())
_HOLDS = _BLOCK - frozenset("p hr h1 h2 h3 h4 h5 h6 li dt dd option tr".split()) | {"button"}
_VOID_SPACE = frozenset(("br", "td", "th", "wbr"))
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>|<[/a-zA-Z!][^<>]*\Z", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|sidebar|side|aside|footer|masthead|ad|ads|adv|advert\w*|banner\w*|promo\w*|sponsor\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|"
    r"newsletter|subscri\w*|signup|login|social|share|sharing|related|recommend\w*|comments?|commentlist|respond|reply|replies|disqus|breadcrumbs?|pagination|pager|widget\w*|toolbar|copyright|legal|search|contentinfo|complementary|site-header|page-header|topbar)(?:[\s_-]|\d|$)",
    re.I,
)
_HEADER = re.compile(r"(?:^|\s)(?:header|banner|site-?header|page-?header|top)(?:\s|$)", re.I)
_WANTED = re.compile(r"(?:^|\s)(?:main|article|articlebody|article-?(?:body|content|text)|post-?(?:body|content)|entry-?content|main-?content|story-?(?:body|content)?|content)(?:\s|$)", re.I)


class Line(NamedTuple):
    text: str
    article: bool  # inside a marked article
    away: bool  # inside a container that never holds the article
    linked: int  # characters of links


def page_lines(page: str | None) -> list[Line]:
    """The text blocks of a page, in order."""
    if not page:
        return []
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    article = away = False
    link_from, linked = -1, 0

    def flush() -> None:
        nonlocal linked, link_from
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                if link_from >= 0:
                    linked += sum(map(len, parts[link_from:]))
                out.append(Line(text, article, away, min(linked, len(text))))
            parts.clear()
        linked, link_from = 0, (0 if link_from >= 0 else -1)

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            if link_from >= 0:
                linked += sum(map(len, parts[link_from:]))
            link_from = -1 if m[2] else len(parts)
        elif name in _VOID_SPACE:
            parts.append(" ")
        elif name in _BLOCK or name in _HOLDS:
            flush()
            if name not in _HOLDS:
                if not m[2] and m[4] and (found := _NAMES.search(m[4])) and _UNWANTED.search(found[1] or found[2] or found[3]):
                    # a single marked block: what follows up to the next block is not wanted
                    stack.append((name, article, away))
                    away = True
                elif m[2]:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            _, article, away = stack[i]
                            del stack[i:]
                            break
                        if stack[i][0] in _HOLDS:
                            break
                elif stack and stack[-1][0] not in _HOLDS:
                    _, article, away = stack.pop()
                continue
            if m[2]:
                link_from = -1
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        _, article, away = stack[i]
                        del stack[i:]
                        break
                continue
            if name == "body" and stack and stack[-1][0] == "head":
                _, article, away = stack.pop()
            stack.append((name, article, away))
            marks = " ".join(x or y or z for x, y, z in _NAMES.findall(m[4])) if m[4] else ""
            if name in ("body", "html"):
                continue
            if name in _AWAY or name == "header" and not article or marks and (_UNWANTED.search(marks) or not article and _HEADER.search(marks)) or m[4] and _HIDDEN.search(m[4]):
                away = True
            elif name in ("article", "main") or marks and _WANTED.search(marks):
                article = True
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """The places in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    where: dict[int, list[int]] = {}
    for j in range(end_b - 1, start - 1, -1):
        where.setdefault(b[j], []).append(j)
    # the least end in b of a common subsequence of each length, with the way back
    tails: list[int] = []
    last: list[tuple] = []
    for i in range(start, end_a):
        for j in where.get(a[i], ()):
            n = bisect.bisect_left(tails, j)
            node = (i, last[n - 1] if n else None)
            if n == len(tails):
                tails.append(j)
                last.append(node)
            elif j < tails[n]:
                tails[n], last[n] = j, node
    middle, node = [], last[-1] if last else None
    while node:
        middle.append(node[0])
        node = node[1]
    return [*range(start), *middle[::-1], *range(end_a, len(a))]


def main_text(lines: list[Line], shared: set[int]) -> str:
    """The article of a page, given which of its lines its partner shares."""
    marked = any(x.article and not x.away for x in lines)
    own = [(i, x) for i, x in enumerate(lines) if not x.away and (x.article or not marked)]
    if sum(len(x.text) for i, x in own if i in shared) > COPY * sum(len(x.text) for _, x in own):
        shared = set()
    own = [x for i, x in own if i not in shared and (marked or 2 * x.linked <= len(x.text))]
    return "\n".join(x.text for x in own)


def address(url: str | None) -> tuple[str | None, list[str]]:
    """The host of a URL, and its path's prefixes from the whole path to the root: three letters off its end, then by folder."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]+)([^?#]*)", url.strip(), re.I) if url else None
    if not m:
        return None, []
    path = re.sub(r"\.(?:html?|php|aspx?|jsp)$", "", m[2].rstrip("/"))
    leaf = path.rfind("/") + 1
    ways = [path, *(path[:i] + "*" for i in range(len(path) - 1, max(leaf, len(path) - 4), -1))]
    folders = path.split("/")[:-1]
    ways += ["/".join(folders[:i]) + "/" for i in range(len(folders), 0, -1)]
    return m[1].lower(), list(dict.fromkeys([*ways, "/"]))


def outlines(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, keys array<string>, content, hashes array<long>): prefixes of the URL from the longest, a hash of all lines, and of each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, content, hashes = [], [], []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            host, ways = address(url)
            keys.append([f"{host}{w}" for w in ways])
            hashes.append([line_hash(x.text) for x in page_lines(page)])
            content.append(line_hash(str(hashes[-1])))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.string())), pa.array(content, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["page", "keys", "content", "hashes"])

    return arrow(pages.select(F.col(id_col).cast("long"), url_col, html_col), run, "page long, keys array<string>, content long, hashes array<long>")


def partners(outlined: DataFrame) -> DataFrame:
    """(page, partner): of the pages with other content that share a prefix, the longest prefix's first or last by content."""
    rows = outlined.where(F.size("hashes") > 0).select("page", "content", F.posexplode("keys").alias("depth", "key"))
    ends = stored(rows.groupBy("key").agg(F.min(F.struct("content", "page")).alias("lo"), F.max(F.struct("content", "page")).alias("hi")).where("lo.content < hi.content"), "prefixes")
    other = F.when(F.col("content") != F.col("lo.content"), F.col("lo.page")).otherwise(F.col("hi.page"))
    return rows.join(ends, "key").groupBy("page").agg(F.min(F.struct("depth", other.alias("partner"))).alias("x")).select("page", "x.partner")


def shared_lines(outlined: DataFrame) -> DataFrame:
    """(page, shared array<int>): the lines of each page that align with its partner's."""
    lines = outlined.select("page", "hashes")
    both = partners(outlined).join(lines, "page").join(lines.toDF("partner", "others"), "partner").select("page", "hashes", "others")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [common_lines(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["page", "shared"])

    # a page that is listed twice has one set of shared lines
    return arrow(both, run, "page long, shared array<int>").dropDuplicates(["page"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text) of every page."""
    outlined = stored(outlines(pages, id_col=id_col, url_col=url_col, html_col=html_col), "outlines")
    shared = stored(shared_lines(outlined), "shared")

    # pages travel once, compressed, to where their shared lines are; at any size, as a merge join
    def squeezed(batch: pa.RecordBatch) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([None if t is None else squeeze(t) for t in batch.column(2).to_pylist()], pa.binary())], [id_col, url_col, "squeezed"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))
    small = arrow(pages.select(id_col, url_col, F.col(html_col).cast("binary")), squeezed, f"{kinds}, squeezed binary")
    rows = small.join(shared.hint("merge"), F.col(id_col).cast("long") == F.col("page"), "left").select(id_col, url_col, "squeezed", "shared")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        expand = zstandard.ZstdDecompressor().decompress
        whole = (None if t is None else expand(t).decode() for t in batch.column(2).to_pylist())
        texts = [main_text(page_lines(page), set(s or ())) for page, s in zip(whole, batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], [id_col, url_col, "text"])

    return arrow(rows, run, f"{kinds}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
