"""Main text of web pages by consensus paths of their host.

Each page's containers are scored: a block of text adds its length and commas, less its links, to its container, half
to the one around and so on. The generalised path (tags with classes, digits made one sign) of the best container is
the page's vote. Votes are counted by host and path in Spark; paths with a twentieth of a host's votes or more win.
Then each page is extracted again from the first of its host's winning paths that it has, or its own best container if
it has none, so that a page with little text, or long comments, still gives the right part.

Blocks are what block elements hold directly; character references are decoded, white space becomes one space, blocks
are joined by an empty line. Menus, headers, footers, side bars, notices, adverts, forms, comments, scripts and styles
are left out by element, role and the words of class and id. Some of these words may name a part of an article and
count outside of one only; an element that also has a word for articles stays if it holds half of the page's text.
Malformed tags are tags up to their '>' (or the page's end), never text.

Null or empty pages, and pages without an article, give an empty text; pages without a url vote together as the empty
host; ties between paths go to the higher score, then to the first path. Rows with repeated or null ids are extracted
each; an empty table gives no rows; columns other than id, url and html are not read, whatever their names. Very long
pages are read whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Hosts, and bytes, whose winning paths are broadcast at most; above, pages are joined with them by a shuffle, in which
#: the adaptive planner splits hot hosts.
BROADCAST_HOSTS, BROADCAST_BYTES = 300_000, 1 << 26
#: Share of a host's votes from which a path wins.
WINS = 0.05

#: Between paths' steps; no class holds it, as it counts as white space.
_STEP = "\x1f"
# quotes only count behind '='; what a page's end cuts off is a tag, too
_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)|[="'])*+"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math", "canvas", "xmp", "noframes"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
_BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul select button".split())
_LEFT_OUT = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "head", "fieldset"}
_WHOLE = {"html", "body", "article", "main"}
#: Words of class and id that mark what isn't the article.
_WORDS_LEFT_OUT = set(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored banner promo promotion cookie cookies
    consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login
    sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar toolbar footer
    social share sharing related recommended recommendations comment comments respond disqus discussion replies reply
    search searchbox pagination pager copyright legal form""".split()
)
#: Of these, what may also name a part of an article, where it stands inside one.
_WORDS_OF_ARTICLES = {"legal", "copyright", "notice", "notices", "alert", "notification", "form", "search", "discussion", "menu", "menus", "banner", "promotion"}
#: Words of class and id that name an article.
_WORDS_KEPT = {"article", "post", "entry", "content", "story", "main", "text", "body", "page", "blog"}
_ROLES_LEFT_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class Block:
    __slots__ = ("text", "linked", "path", "perhaps")

    def __init__(self, text: str, linked: int, path: tuple[str, ...], perhaps: tuple[int, ...] = ()):
        self.text, self.linked, self.path, self.perhaps = text, linked, path, perhaps


@lru_cache(maxsize=20_000)
def _element(tag: str, attributes: str) -> tuple[str, str, bool]:
    """An element's step in a path; why it is left out ("" not, "tag" for good, "inside" unless in an article, "word" by
    a word, "both" by a word beside one that names an article); whether it is a header, which an article may keep."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    classes = re.sub(r"\d+", "#", ".".join(sorted(found.get("class", "").split())))
    step = f"{tag}.{classes}" if classes and tag not in ("html", "body") else tag
    words = {w.lower() for w in _WORD.findall(found.get("class", "") + " " + found.get("id", ""))}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    header = tag == "header" or bool(words & {"header", "top"})
    why, out = "", words & _WORDS_LEFT_OUT
    if tag not in _WHOLE:
        if tag in _LEFT_OUT or found.get("role", "").lower() in _ROLES_LEFT_OUT or hidden:
            why = "tag"
        elif out:
            why = "both" if words & _WORDS_KEPT else "inside" if out <= _WORDS_OF_ARTICLES else "word"
    return step, why, header and tag not in _WHOLE


def blocks(html: str) -> list[Block]:
    """The blocks of text that may belong to an article, in page order, with the paths of the elements around."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, tuple[int, ...]]] = []  # tag, step, left out, elements around that may be left out
    weights: dict[int, int] = {}  # characters in each of these
    named = 0
    parts: list[str] = []
    linked = at = links = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not (stack and stack[-1][2]):
                perhaps = stack[-1][3] if stack else ()
                for e in perhaps:
                    weights[e] = weights.get(e, 0) + len(text)
                out.append(Block(text, min(linked, len(text)), tuple(x[1] for x in stack), perhaps))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text)

    while m := _TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in _BLOCK:
                end()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
        elif tag in _RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else len(html)
        elif tag == "br" or tag == "hr":
            if tag == "hr":
                end()
            else:
                parts.append(" ")
        elif tag == "a":
            links += 1
        elif tag in _BLOCK and not (tag in _VOID or m[3].endswith("/")):
            end()
            if stack and stack[-1][0] == "p":
                stack.pop()
            while stack and stack[-1][0] in _CLOSES.get(tag, ()):
                stack.pop()
            step, why, header = _element(tag, m[3])
            inside = any(x[0] in ("article", "main") for x in stack)
            left_out = why in ("tag", "word") or (why == "inside" or header) and not inside
            perhaps = stack[-1][3] if stack else ()
            if why == "both" and not left_out:
                named += 1
                perhaps = (*perhaps, named)
            stack.append((tag, step, left_out or bool(stack and stack[-1][2]), perhaps))
    add(html[at:])
    end()
    # an element with a word for either side is left out unless that takes half of the page
    total = sum(len(b.text) for b in out)
    gone = {e for e, n in weights.items() if 2 * n < total}
    return [b for b in out if not gone.intersection(b.perhaps)] if gone else out


def _containers(path: tuple[str, ...]) -> list[tuple[str, ...]]:
    """Paths of the containers around a block's text, the nearest first; paragraphs and headings contain no others."""
    n = len(path)
    while n and re.match(r"(p|h[1-6]|pre|li|td|th|dd|dt|figcaption|blockquote|tr|tbody|ul|ol)\b", path[n - 1]):
        n -= 1
    return [path[:i] for i in range(n, 0, -1)] or [()]


def best_container(found: list[Block]) -> tuple[tuple[str, ...], float]:
    scores: dict[tuple[str, ...], float] = {}
    for b in found:
        own = max(0.0, len(b.text) - 2 * b.linked) + 10 * b.text.count(",")
        for c in _containers(b.path):
            bonus = 1.5 if c and re.match(r"(article|main)\b", c[-1]) else 1.0
            scores[c] = scores.get(c, 0.0) + own * bonus
            own *= 0.5
            if own < 1:
                break
    return max(scores.items(), key=lambda x: (x[1], x[0]), default=((), 0.0))


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, score of each page that has text."""

    def vote(batches):
        for batch in batches:
            rows = [(h, *best_container(blocks(t))) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t]
            rows = [r for r in rows if r[2] > 0]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([_STEP.join(r[1]) for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["host", "path", "score"])

    return pages.select(_host(url).alias("host"), F.col(html).alias("html")).mapInArrow(vote, "host string, path string, score double")


def _host(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, paths: its winning paths, the one with most votes first."""
    counted = votes(pages, url, html).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    shared = counted.withColumn("all", F.sum("n").over(Window.partitionBy("host"))).where(F.col("n") >= WINS * F.col("all"))
    return shared.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("n"), -F.col("score"), "path"))), lambda x: x["path"]).alias("paths"))


def main_text(html: str, paths: list[str]) -> str:
    found = blocks(html)
    for path in paths:
        steps = tuple(path.split(_STEP)) if path else ()
        inside = [b.text for b in found if b.path[: len(steps)] == steps]
        if inside:
            return "\n\n".join(inside)
    own, _ = best_container(found)
    return "\n\n".join(b.text for b in found if b.path[: len(own)] == own)


def extracted(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    winners = written(winning_paths(pages, url, html), "paths").withColumnRenamed("host", "host_")
    hosts, size = winners.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat_ws("", "host_", F.array_join("paths", "")))), F.lit(0))).first()
    few = hosts <= BROADCAST_HOSTS and size <= BROADCAST_BYTES

    def extract(batches):
        for batch in batches:
            texts = [main_text(h, p or []) if h else "" for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), _host(url).alias("host"))
    joined = rows.join(F.broadcast(winners) if few else winners, F.col("host") == F.col("host_"), "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(extract, f"page_id {pages.schema[id].dataType.simpleString()}, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
