"""Main text of web pages by composite text density."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import textkernel as tk

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; it ends at the end tag only.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: They don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are not of the article; roles, and words of a class or an id that say so.
ELSEWHERE = frozenset("nav header footer aside script style noscript iframe button select input textarea template dialog menu svg math canvas object embed audio video map head title frameset noframes noembed datalist".split())
FORMS = frozenset(["form", "fieldset"])
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations widget toolbar pagination pager copyright paywall skip".split()
)
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
#: A class or id with one of these words says how the page is laid out, not what the element is.
LAYOUT = frozenset("no not has have with without hide hidden show is layout page site body main content wrapper wrap container grid row col column".split())
ARTICLE = frozenset(["article", "main"])
#: Their start ends an open paragraph.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag of the key ends an open element of the values (and what is open inside it).
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]), "thead": frozenset(["tr", "td", "th"]), "tfoot": frozenset(["thead", "tbody", "tr", "td", "th"])}
#: An implied end stops at these.
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
TABLE = frozenset(["table"])

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ENDS: dict[str, re.Pattern] = {}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _ends(tag: str) -> re.Pattern:
    """The end tag of a RAW element."""
    if tag not in _ENDS:
        _ENDS[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I)
    return _ENDS[tag]


#: What an element's tag or attributes say of it.
NOTHING, GONE, DOUBTFUL, READERS = 0, 1, 2, 3
#: An element of which so much of the text is chosen is one with it.
MOST = 0.7


def _marked(value: str) -> int:
    """What a class or id says: a token counts by its first or last word, unless it tells of the layout."""
    found = NOTHING
    for token in value.split():
        words = [w.lower() for w in WORD.findall(token)]
        if not words or (len(words) > 1 and not LAYOUT.isdisjoint(words)):
            continue
        ends = {words[0], words[-1]}
        if ends & COMMENTS:
            return READERS
        if ends & MARKS:
            found = DOUBTFUL
    return found


def _said(tag: str, attributes: str) -> int:
    if tag in ELSEWHERE:
        return GONE
    found = DOUBTFUL if tag in FORMS else NOTHING
    if not attributes or tag in ARTICLE or tag in ("html", "body"):
        return found
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            found = max(found, _marked(value))
        elif name == "role":
            if value.strip().lower() in ROLES:
                found = max(found, DOUBTFUL)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            found = max(found, DOUBTFUL)
    return found


class _Open:
    """The open elements, and for each tag where in the stack it is open, so that no step searches the stack."""

    def __init__(self) -> None:
        self.elements, self.names = [0], ["#root"]
        self.where: dict[str, list[int]] = {"#root": [0]}
        #: Open elements that are not inline.
        self.outer = [0]

    def push(self, element: int, tag: str) -> None:
        at = len(self.elements)
        self.elements.append(element)
        self.names.append(tag)
        self.where.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.outer.append(at)

    def cut(self, at: int) -> None:
        """Close the element at place `at` and what is open inside it."""
        while len(self.elements) > at:
            self.elements.pop()
            self.where[self.names.pop()].pop()
        while self.outer[-1] >= at:
            self.outer.pop()

    def innermost(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def imply(self, tag: str) -> None:
        """End the elements that a start tag ends."""
        ends = CLOSES.get(tag)
        if ends:
            stop = self.innermost(SCOPE.get(tag, TABLE))
            # The outermost of those inside the scope.
            inside = [next(at for at in places if at > stop) for t in ends if (places := self.where.get(t)) and places[-1] > stop]
            if inside:
                self.cut(min(inside))
        elif tag in BLOCKS and self.names[self.outer[-1]] == "p":
            # A paragraph ends unless something that may hold blocks was opened inside it.
            self.cut(self.outer[-1])


class Page:
    """A page's elements in order: parent, tag, whether it is of the article, and text with the element it stands in."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.said = [-1], ["#root"], [NOTHING]
        #: (element, text) or (element, None) for a break, in page order.
        self.text: list[tuple[int, str | None]] = []
        self._parse(source)
        #: Characters that are no white space, of the element's own text.
        self.own = [0] * len(self.tag)
        for i, s in self.text:
            if s is not None:
                self.own[i] += len("".join(s.split()))
        self.dropped = self._drop()

    def _parse(self, source: str) -> None:
        stack, at, n = _Open(), 0, len(source)
        text = self.text
        # No tag begins after the last ">", and an end tag that is not found once is not looked for again.
        last, endless = source.rfind(">") + 1, set()
        while at < n:
            found = TOKEN.search(source, at, last)
            if not found:
                text.append((stack.elements[-1], source[at:]))
                break
            if found.start() > at:
                text.append((stack.elements[-1], source[at : found.start()]))
            at = found.end()
            end, tag, attributes = found[1], found[2], found[3]
            if tag is None:
                end, tag, attributes = found[4], found[5], found[6]
                if tag is None:
                    continue
            tag = tag.lower()
            if end:
                if tag == "br":
                    text.append((stack.elements[-1], None))
                elif place := stack.innermost([tag]):
                    stack.cut(place)
                continue
            stack.imply(tag)
            element = len(self.tag)
            self.parent.append(stack.elements[-1])
            self.tag.append(tag)
            self.said.append(_said(tag, attributes))
            if tag in VOID:
                if tag in ("br", "hr"):
                    text.append((element, None))
                continue
            if tag in RAW:
                close = None if tag in endless else _ends(tag).search(source, at)
                if close:
                    at = close.end()
                    continue
                endless.add(tag)
                if tag in ("script", "style"):
                    break
                continue
            if not attributes.endswith("/") or tag not in ("svg", "path"):
                stack.push(element, tag)

    def _drop(self) -> list[bool]:
        """The elements that are not of the article by their tag or by what they say.

        A doubtful element (marked by class, id or role, or a form) stays if it holds most of the page's text and an article
        or first heading is inside it or nowhere; what is marked as said by readers only if all of them are inside.
        """
        n, parent, tag, said = len(self.tag), self.parent, self.tag, self.said
        gone = [False] * n
        size, heads = [0] * n, [0] * n
        for i in range(1, n):
            gone[i] = gone[parent[i]] or said[i] == GONE
            if not gone[i]:
                size[i] = self.own[i]
            heads[i] = tag[i] in ARTICLE or tag[i] == "h1"
        size[0] = self.own[0]
        for i in range(n - 1, 0, -1):
            size[parent[i]] += size[i]
            heads[parent[i]] += heads[i]
        dropped, of_article, of_header = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            up = parent[i]
            mark = said[i]
            if 2 * size[i] > size[0]:
                if mark == DOUBTFUL and (heads[i] or not heads[0]) or mark == READERS and 0 < heads[i] == heads[0]:
                    mark = NOTHING
            dropped[i] = dropped[up] or mark != NOTHING
            of_article[i] = of_article[up] or tag[i] in ARTICLE
            if tag[i] == "header":
                of_header[i] = of_article[up] and not dropped[up]
            elif of_header[up] and mark == NOTHING:
                # Of an article's header the headings stay.
                if tag[i] in HEADINGS:
                    dropped[i] = False
                else:
                    of_header[i] = True
        return dropped

    def measures(self) -> tuple[int, list[int], list[int], list[float], list[float]]:
        """The body element (0: the root), and of each element its characters, those in links, its density and the sum of its children's densities."""
        n, parent, tag, dropped = len(self.tag), self.parent, self.tag, self.dropped
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(n):
            in_link[i] = i > 0 and (in_link[parent[i]] or tag[i] == "a")
            if not dropped[i]:
                chars[i] = self.own[i]
                links[i] = self.own[i] * in_link[i]
        for i in range(n - 1, 0, -1):
            if not dropped[i]:
                tags[i] += 1
                link_tags[i] += tag[i] == "a"
            up = parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i]
            link_tags[up] += link_tags[i]
        body = next((i for i in range(1, n) if tag[i] == "body"), 0)
        if chars[0] > chars[body]:
            body = 0  # text outside of the body element
        ratio = links[body] / max(1, chars[body])
        density, total = [0.0] * n, [0.0] * n
        for i in range(n):
            if chars[i] and not dropped[i]:
                c, lc, t, lt = chars[i], max(1, links[i]), max(1, tags[i]), max(1, link_tags[i])
                base = log(log(c * lc / max(1, c - links[i]) + ratio * c + e))
                density[i] = max(0.0, c / t * log(max(1.0, c * t / (lc * lt))) / base) if base > 0 else float(c) / t
        for i in range(n - 1, 0, -1):
            total[parent[i]] += density[i]
        return body, chars, links, density, total

    def select(self) -> list[bool]:
        """The elements of the main text.

        Of each element as dense as the least dense one on the path from the body to the greatest density sum, the subtree
        with the greatest sum is chosen. Up to the element that holds all that is chosen (or the article around it),
        an element of which MOST is chosen is chosen whole, if the rest is not mostly links: headings and short
        paragraphs between dense ones.
        """
        n, parent, tag, dropped = len(self.tag), self.parent, self.tag, self.dropped
        body, chars, links, density, total = self.measures()
        if not chars[body]:
            return [False] * n
        # The best descendant of each element, itself included.
        best = list(range(n))
        for i in range(n - 1, 0, -1):
            up = parent[i]
            if total[best[i]] > total[best[up]]:
                best[up] = best[i]
        threshold, at = density[best[body]], best[body]
        while at != body and at > 0:
            at = parent[at]
            threshold = min(threshold, density[at])
        chosen, under = [False] * n, [False] * n
        for i in range(n):
            under[i] = i == body or (i > 0 and under[parent[i]])
            if under[i] and density[i] > 0 and density[i] >= threshold:
                chosen[best[i]] = True
        held, linked = [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            chosen[i] = chosen[i] or chosen[parent[i]]
        for i in range(n):
            in_link[i] = i > 0 and (in_link[parent[i]] or tag[i] == "a")
            if chosen[i] and not dropped[i]:
                held[i], linked[i] = self.own[i], self.own[i] * in_link[i]
        sums = held[:]
        for i in range(n - 1, 0, -1):
            sums[parent[i]] += sums[i]
        top = max(i for i in range(n) if sums[i] == sums[0])
        around = top
        while around > 0 and tag[around] not in ARTICLE:
            around = parent[around]
        limit = around if around > 0 else top
        inside = [False] * n
        for i in range(n):
            inside[i] = i == limit or (i > 0 and inside[parent[i]])
        for i in range(n - 1, -1, -1):
            if inside[i] and not chosen[i] and not dropped[i] and chars[i] and held[i] >= MOST * chars[i] and 2 * (links[i] - linked[i]) <= chars[i] - held[i]:
                chosen[i] = True
                held[i], linked[i] = chars[i], links[i]
            if i:
                held[parent[i]] += held[i]
                linked[parent[i]] += linked[i]
        for i in range(1, n):
            chosen[i] = chosen[i] or chosen[parent[i]]
        return [c and not d for c, d in zip(chosen, dropped)]

    def main_text(self) -> str:
        chosen = self.select()
        out: list[str] = []
        last = 0
        block = [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            block[i] = block[self.parent[i]] if self.tag[i] in INLINE else i
        for i, s in self.text:
            if not chosen[i]:
                continue
            if s is None:
                out.append(" ")
                continue
            if block[i] != last:
                out.append(" ")
                last = block[i]
            out.append(unescape(s))
        return " ".join("".join(out).split())


def main_text(source: str | None) -> str:
    """The main text of a page; empty for null, empty or textless pages."""
    return Page(source).main_text() if source else ""


def _extract(at: int, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s.as_py()) for s in batch.column(at)]
            rest = [c for j, c in enumerate(batch.columns) if j != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return run


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the html column, with text (string) and n_chars (long, its code points).

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go by element,
    role, class or id (see Page._drop), and what is left is chosen by composite text density: characters to tags, adjusted
    by links; the subtree with the greatest sum of its children's densities, and those of all elements as dense as the least
    dense one on its path from the body. Headings in the header of an article stay. White space in a block becomes one
    space; blocks are joined by one. Null, empty or textless pages give an empty text. All rows stay, repeated ones
    too; pages of any length are read whole; columns named text or n_chars are replaced.
    """
    kept = pages.drop(*({"text", "n_chars"} - {html}))
    names = [c for c in kept.columns if c != html]
    fields = [f for f in kept.schema.fields if f.name != html]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return tk.small_batches(kept).mapInArrow(_extract(kept.columns.index(html), [*names, "text", "n_chars"]), schema)


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract over all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
