"""Main text of web pages by composite text density.

A page is parsed leniently into a tree. Every node gets its characters for each tag, adjusted by how much of them are
links and by how much of the whole body is; a node's density sum adds the densities of its children. The node of the
greatest sum is the core of the article. The least density on the path from the body to the core is the threshold: a node
at or above it gives the greatest-sum subtree below it to the text as well. Parts that are no article by their element or by
what their class, id or role calls them are cut away before.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm.rows import pick, raw, slices

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title iframe noembed noframes xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                              "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset("td th".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
SCOPE = frozenset("caption html object table td template th".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "a": ("a",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th")}
LISTS = {"li": frozenset("ul ol menu dir".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
ENDS_PARAGRAPH = BLOCKS - frozenset("body html caption legend optgroup option tbody tfoot thead tr".split())

# Elements that hold no article text, and words of class, id or role that say the same of any element.
UNSEEN = RAW_TEXT | frozenset("head noscript template object svg math canvas audio video map select datalist".split())
NO_ARTICLE = frozenset("nav aside footer menu dialog button label form search".split())
COMMENT_WORDS = frozenset("comment comments commentary commentlist disqus replies reactions respond".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors promo promos promotion promoted "
                        "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars rail footer foot masthead topbar toolbar "
                        "cookie cookies consent gdpr notice notices disclaimer banner popup modal overlay newsletter subscribe subscription signup login "
                        "share sharing social related recommended recommendations teaser teasers widget widgets complementary contentinfo skip copyright form".split())
HEADER_WORDS = frozenset(["header"])
NEGATIONS = frozenset("with has no without not hide".split())

MAX_DEPTH = 512
LINKED_SHARE = 0.8
LEAST_LINKS = 3
LINK_LISTS = frozenset("ul ol dl div section table".split())

TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?/](?![a-zA-Z])[^>]*>?|![^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Run(NamedTuple):
    """A piece of text right inside element ``node``; runs of one ``block`` make up one line of the result."""

    node: int
    block: int
    text: str


class Page:
    """The tree of one page: parents stand before their children, node 0 is the root."""

    __slots__ = ("tag", "parent", "said", "runs")

    def __init__(self, html: str):
        self.tag, self.parent, self.said, self.runs = ["#root"], [-1], [frozenset()], []
        self._parse(html)

    def _parse(self, html: str) -> None:
        tags, parents, said, runs = self.tag, self.parent, self.said, self.runs
        stack, open_, block, at, end = [0], Counter(), 0, 0, len(html)

        def pop_to(place: int) -> None:
            while len(stack) > place:
                open_[tags[stack.pop()]] -= 1

        def close(names, walls) -> None:
            if any(open_[n] for n in names):
                for place in range(len(stack) - 1, 0, -1):
                    name = tags[stack[place]]
                    if name in names:
                        return pop_to(place)
                    if name in walls:
                        return None
            return None

        while at < end:
            found = TAG.search(html, at)
            stop = found.start() if found else end
            if stop > at:
                text = html[at:stop]
                if open_["head"] and not text.isspace() and tags[stack[-1]] in ("head", "html"):
                    close(("head",), ())
                runs.append(Run(stack[-1], block, unescape(text) if "&" in text else text))
            if not found:
                break
            at = found.end()
            name = found[2] or found[5]
            if name is None:
                continue
            name = name.lower()
            if found[1] or found[4]:
                block += name in BLOCKS
                if name in ("body", "html") or not open_[name]:
                    continue
                if name == "a" or name in BLOCKS or name in CELLS or name in UNSEEN:
                    close((name,), LISTS.get(name, frozenset()) if name in LISTS else SCOPE - {name})
                else:
                    close((name,), BLOCKS | CELLS)
                continue
            if open_["head"] and name not in IN_HEAD:
                close(("head",), ())
            if name in ("html", "body") and open_[name]:
                continue
            if name in ENDS_PARAGRAPH and open_["p"]:
                close(("p",), SCOPE | {"button"})
            if name in CLOSED_BY:
                close(CLOSED_BY[name], LISTS.get(name, frozenset(["table"]) if name != "a" else SCOPE))
            elif name in HEADINGS and tags[stack[-1]] in HEADINGS:
                pop_to(len(stack) - 1)
            block += name in BLOCKS
            if name == "br" or name in CELLS:
                runs.append(Run(stack[-1], block, " "))
            if len(stack) >= MAX_DEPTH:
                pop_to(len(stack) - 1)
            attributes = found[3] or found[6] or ""
            node = len(tags)
            tags.append(name)
            parents.append(stack[-1])
            said.append(_words(attributes) if attributes and name not in ("html", "body") else frozenset())
            if name in RAW_TEXT:
                at = _raw_end(html, name, at)
            elif name not in VOID and not (attributes.endswith("/") and name in ("svg", "path")):
                stack.append(node)
                open_[name] += 1


def _raw_end(html: str, name: str, at: int) -> int:
    found = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
    return found.end() if found else len(html)


def _words(attributes: str) -> frozenset[str]:
    """What class, id and role call an element, without words behind a negation; ``hidden`` where it is not shown."""
    out = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        value = values[0] or values[1] or values[2]
        name = name.lower()
        if name == "hidden" or name == "style":
            if name == "hidden" or HIDDEN.search(value):
                out.add("hidden")
            continue
        for part in value.split():
            words = [w.lower() for w in NAME_WORDS.findall(part)]
            out.update(w for i, w in enumerate(words) if not (i and words[i - 1] in NEGATIONS) and w != "hidden")
    return frozenset(out)


def _cut(page: Page, length: list[int]) -> tuple[list[bool], list[bool]]:
    """Per node: never seen as text; no part of an article. Both hold for all below a node, too."""
    tag, parent, said = page.tag, page.parent, page.said
    n = len(tag)
    remark = [bool(said[i] & COMMENT_WORDS) for i in range(n)]
    noise = [bool(said[i] & NOISE_WORDS) or tag[i] in NO_ARTICLE for i in range(n)]
    prose, landmark, chars = [0] * n, [False] * n, [0] * n
    for run, size in zip(page.runs, length):
        chars[run.node] += size
    for i in range(n - 1, 0, -1):
        up = parent[i]
        if tag[i] in ("p", "pre", "blockquote") and not remark[i]:
            prose[i] += chars[i]
        else:
            chars[up] += chars[i]
        prose[up] += prose[i]
        landmark[up] |= landmark[i] or (tag[i] in ("article", "main") and not noise[i] and not remark[i])
    unseen, cut, inside = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        up = parent[i]
        unseen[i] = unseen[up] or tag[i] in UNSEEN or "hidden" in said[i]
        inside[i] = inside[up] or tag[i] in ("article", "main")
        holds = landmark[i] or tag[i] == "main" or (prose[i] * 2 > prose[0] and tag[i] not in ("nav", "footer", "aside"))
        header = (tag[i] == "header" or bool(said[i] & HEADER_WORDS)) and not inside[up]
        cut[i] = cut[up] or (remark[i] and not (landmark[i] and tag[i] in ("main", "article"))) or ((noise[i] or header) and not holds)
    return unseen, cut


def main_blocks(html: str) -> list[str]:
    """The blocks of the main text, in page order, white space inside made single spaces."""
    page = Page(html)
    tag, parent, runs = page.tag, page.parent, page.runs
    n = len(tag)
    length = [len(" ".join(r.text.split())) for r in runs]
    unseen, cut = _cut(page, length)
    link = [False] * n
    for i in range(1, n):
        link[i] = link[parent[i]] or tag[i] == "a"
    body_chars = sum(k for r, k in zip(runs, length) if not unseen[r.node])
    body_linked = sum(k for r, k in zip(runs, length) if not unseen[r.node] and link[r.node])
    if not body_chars:
        return []
    ratio = body_linked / body_chars
    chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
    for run, size in zip(runs, length):
        if not (cut[run.node] or unseen[run.node]):
            chars[run.node] += size
            linked[run.node] += size * link[run.node]
    for i in range(n - 1, 0, -1):
        if cut[i] or unseen[i]:
            continue
        if tag[i] in LINK_LISTS and links[i] >= LEAST_LINKS and linked[i] >= LINKED_SHARE * chars[i]:
            cut[i] = True  # a list of links is a menu whatever it is called
            continue
        up = parent[i]
        chars[up] += chars[i]
        tags[up] += tags[i] + 1
        linked[up] += linked[i]
        links[up] += links[i] + (tag[i] == "a")
    for i in range(1, n):
        cut[i] = cut[i] or unseen[i] or cut[parent[i]]

    def density(c: int, t: int, lc: int, lt: int) -> float:
        if not c:
            return 0.0
        plain = c / max(t, 1)
        if not body_linked:
            return plain
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        return plain * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / math.log(base)

    dense = [0.0 if cut[i] else density(chars[i], tags[i], linked[i], links[i]) for i in range(n)]
    total = [0.0] * n
    for run, size in zip(runs, length):
        if size and not cut[run.node]:
            total[run.node] += density(size, 1, size * link[run.node], int(link[run.node]))
    for i in range(n - 1, 0, -1):
        total[parent[i]] += dense[i]
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        if not cut[i] and total[best[i]] >= total[best[parent[i]]]:
            best[parent[i]] = best[i]
    core = best[0]
    if not chars[core]:
        return []
    threshold, at = dense[core], core
    while at > 0:
        threshold, at = min(threshold, dense[at]), parent[at]
    marked = [False] * n
    for i in range(n):
        if not cut[i] and chars[i] and dense[i] >= threshold and not _within(i, marked, parent):
            marked[best[i]] = True
    _whole_article(core, marked, cut, tag, parent)
    for i in range(1, n):
        marked[i] = (marked[i] or marked[parent[i]]) and not cut[i]
    out: dict[int, list[str]] = {}
    for run in runs:
        if marked[run.node]:
            out.setdefault(run.block, []).append(run.text)
    joined = (" ".join("".join(parts).split()) for parts in out.values())
    return [text for text in joined if text]


def _within(i: int, marked: list[bool], parent: list[int]) -> bool:
    """Whether ``i`` or a node above it is marked. Depth is bounded, so the walk is."""
    while i >= 0:
        if marked[i]:
            return True
        i = parent[i]
    return False


def _whole_article(core: int, marked: list[bool], cut: list[bool], tag: list[str], parent: list[int]) -> None:
    """Mark the article element round the core, or the headings that stand before marked nodes beside them."""
    at = core
    while at > 0 and tag[at] != "article":
        at = parent[at]
    if at > 0:
        marked[at] = True
        return
    heading: dict[int, list[int]] = {}
    for i in range(1, len(tag)):
        up = parent[i]
        if cut[i]:
            continue
        if tag[i] in HEADINGS:
            heading.setdefault(up, []).append(i)
        elif tag[i] in BLOCKS:
            waiting = heading.pop(up, ())
            if marked[i]:
                for h in waiting:
                    marked[h] = True


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        texts = ["\n\n".join(main_blocks((h or b"").decode("utf-8", "replace"))) for h in raw(part, "html")]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``; a map without a shuffle, row by row.

    ``text`` holds the blocks of the main text joined by an empty line, ``n_chars`` its code points. A null or empty page
    and one without article text give an empty text. Null ids and urls stay null, repeated rows each come back, an empty
    table gives an empty result. Bytes that are not UTF-8 become replacement characters. White space is what Unicode calls
    so, no-break spaces among it. Very long pages are read whole; elements nested more than 512 deep are laid side by side.
    """
    page_type = pages.schema[[c.lower() for c in pages.columns].index(id_col.lower())].dataType.simpleString()
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    return rows.mapInArrow(_extract, f"page_id {page_type}, url string, text string, n_chars long")
