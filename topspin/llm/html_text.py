"""Main text of web pages by composite text density (operator 5).

After Sun, Song and Liao ("DOM based content extraction via text density", 2011). For every element, characters per
tag are adjusted for the share of links in it (``density``); the densities of an element's children add up to
its sum. The element with the greatest sum is the core of the article, and the least density on the way from it up to the body is the threshold.

The text is that of the article (or else main) element around the core. On a page without one it is that of the smallest element which holds
the core and all that stands beside the way up to it and reaches the threshold; of what else stands beside that way, paragraphs, headings, lists and the like belong to it if they
aren't mostly links.

Elements of another purpose by their tag (menus, forms, footers and so on) and readers' comments are taken out first, together with articles inside of them,
unless that is the page's only article. Other names in class, id and role only lower an element's sum, by ``LOWERED``: one that doesn't hold the core and whose lowered sum is
below the threshold is left out.
Inline elements other than links count as part of the element that they are in.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topspin.llm.shared import by_bytes

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: One attribute, or what stands between attributes. A quote only opens a value behind an equals sign; one that is never closed is an ordinary character.
_ATTRIBUTE = re.compile(r"""[\s/]++|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)|(?=>)))?+""")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
IN_HEAD = frozenset("meta link title script style base noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("nav footer aside form button select dialog menu head svg annotation annotation-xml".split())
FOREIGN = ("svg", "math")
#: Elements that end an unclosed drawing or formula. Fixed values.
BREAK_OUT = frozenset("article aside blockquote body br center dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr img li main nav ol p pre section table ul".split())
#: Parts of class, id and role names that mark what isn't the article, those of them that mark readers' words, and first parts that tell of another element. Fixed values.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements banner sponsor sponsored promo promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer"
    " comment comments commentlist disqus reply replies cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login social share sharing related"
    " recommended popup modal overlay toolbar search contentinfo complementary skip".split()
)
READERS = frozenset("comment comments commentlist disqus reply replies".split())
ELSEWHERE = frozenset("has with without no is hide show js layout".split())
#: By how much a mark lowers the densities of an element.
LOWERED = 4
#: Elements that hold an article's words, those of them that hold sentences, and others that stand between them.
SENTENCES = frozenset("p blockquote pre".split())
PROSE = SENTENCES | frozenset("h1 h2 h3 h4 h5 h6 ul ol dl dt dd li table figure figcaption details summary hgroup math address".split())
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
ALSO_CLOSES = {"dt": ("dd",), "dd": ("dt",), "td": ("th",), "th": ("td",), "tbody": ("thead",), "tfoot": ("tbody",), "tr": ("td", "th")}


def _mark(attributes: dict[str, str]) -> int:
    """What names say of an element: 0 nothing, 1 not the article, 2 readers' words, 3 hidden."""
    if "hidden" in attributes or _HIDING.search(attributes.get("style", "")):
        return 3
    found = 0
    for name in " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower().split():
        parts = re.split(r"[^a-z0-9]+", name)
        if parts[0] not in ELSEWHERE:
            found = max(found, 2 if READERS.intersection(parts) else int(not MARKS.isdisjoint(parts)))
    return found


class Page:
    """The elements of a page in document order, by parallel lists; element 0 stands for the page. Parsing takes time in proportion to the page."""

    def __init__(self, source: str):
        self.tags, self.parents, self.out, self.marks = [""], [-1], [False], [0]
        #: Text pieces in page order, with their elements; an element of -1 is a block's border.
        self.pieces: list[tuple[int, str]] = []
        #: Open elements, the places of each tag among them, and the places of those that aren't inline.
        self._open, self._at, self._blocks = [0], {}, [0]
        self._raw: dict[str, re.Match | None] = {}
        self._parse(source)

    def _parse(self, source: str) -> None:
        at, length, last, loose = 0, len(source), source.rfind(">"), False
        while at < length:
            start = source.find("<", at)
            if start < 0 or start > last:
                self._text(source[at:])
                return
            if start > at:
                self._text(source[at:start])
            at = start
            if source.startswith("<!--", at):
                end = source.find("-->", at + 2)
                at = end + 3 if end >= 0 else length
                continue
            closing = source.startswith("/", at + 1)
            name = _NAME.match(source, at + 1 + closing)
            if name is None:
                if source[at + 1 : at + 2] in ("!", "?", "/"):
                    at = source.find(">", at) + 1
                else:
                    self._text("<")
                    at += 1
                continue
            attributes, at, whole = self._attributes(source, name.end(), loose)
            if not whole:  # no end outside of quotes: from here on, the next ``>`` ends a tag
                loose, at = True, source.find(">", name.end()) + 1
            tag = name[0].lower()
            if closing:
                self._end(tag)
            else:
                at = self._start(source, tag, attributes, at)

    @staticmethod
    def _attributes(source: str, at: int, loose: bool) -> tuple[dict[str, str], int, bool]:
        """Attributes by lower-case names, the place behind the tag, and whether the tag ends."""
        end = source.find(">", at)
        if loose:
            return {}, end + 1, True
        if end == at:
            return {}, end + 1, True
        found: dict[str, str] = {}
        while at < len(source):
            if source[at] == ">":
                return found, at + 1, True
            m = _ATTRIBUTE.match(source, at)
            at = m.end()
            if m[1]:
                found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
            elif m[0].endswith("/") and source.startswith(">", at):
                found["/"] = ""
        return found, at, False

    def _text(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.pieces.append((self._open[-1], text))

    def _last(self, tag: str) -> int:
        """The place of the last open element of that tag, or -1."""
        places = self._at.get(tag)
        return places[-1] if places else -1

    def _close(self, place: int) -> None:
        """Close the open elements from ``place`` on."""
        for k in range(len(self._open) - 1, place - 1, -1):
            self._at[self.tags[self._open[k]]].pop()
            if self._blocks[-1] == k:
                self._blocks.pop()
        del self._open[place:]

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self.pieces.append((-1, ""))
        place = self._last(tag)
        if place > 0:
            self._close(place)

    def _start(self, source: str, tag: str, attributes: dict[str, str], at: int) -> int:
        """Open an element; returns the place to go on from."""
        foreign = max(map(self._last, FOREIGN))
        if foreign > 0 and tag in BREAK_OUT and self._last("foreignobject") < foreign:
            self._close(foreign)
            foreign = -1
        if tag not in INLINE:
            self.pieces.append((-1, ""))
        mark = _mark(attributes) if attributes and tag not in ("html", "body", "main") else 0
        if tag in INLINE and tag != "a" and not mark and self._last(tag) < 0:
            return at
        self._imply_ends(tag)
        if tag in VOID:
            return at
        if tag in RAW:
            end = self._raw_end(source, tag, at)
            if end and "/" in attributes and re.compile(f"<{tag}", re.I).search(source, at, end.start()):
                end = None  # the end of a later one
            return end.end() if end else at if "/" in attributes else len(source)
        node, place = len(self.tags), len(self._open)
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        inside = self._last("article") > 0 or self._last("main") > 0
        self.out.append(tag in LEFT_OUT or mark == 3 or tag == "header" and not inside)
        self.marks.append(mark)
        if "/" in attributes and (foreign > 0 or tag in FOREIGN):
            return at
        self._open.append(node)
        self._at.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self._blocks.append(place)
        return at

    def _raw_end(self, source: str, tag: str, at: int) -> re.Match | None:
        """The next end of a raw element; each is looked for once."""
        end = self._raw.get(tag)
        if tag not in self._raw or end and end.start() < at:
            end = self._raw[tag] = re.compile(rf"</{tag}\s*+>?", re.I).search(source, at)
        return end

    def _imply_ends(self, tag: str) -> None:
        if tag not in INLINE and tag not in VOID and self.tags[self._open[self._blocks[-1]]] == "p":
            self._close(self._blocks[-1])
        if limits := CLOSED_BY_SAME.get(tag):
            border = max(map(self._last, limits))
            place = min((p for t in (tag, *ALSO_CLOSES.get(tag, ())) if (p := self._last(t)) > border), default=-1)
            if place > 0:
                self._close(place)
        if tag not in IN_HEAD and self.tags[self._open[-1]] == "head":
            self._close(len(self._open) - 1)

    def _up(self, own: list[int]) -> list[int]:
        """The sums over subtrees; what is left out adds nothing."""
        for k in range(len(own) - 1, 0, -1):
            if not self.out[k]:
                own[self.parents[k]] += own[k]
        return own

    def _below(self, own: list[bool]) -> list[bool]:
        """What holds for an element or for one that it is in."""
        for k in range(1, len(own)):
            own[k] = own[k] or own[self.parents[k]]
        return own

    def _unlinked(self, out: list[bool]) -> list[int]:
        """Characters outside of links in each subtree, without what is out."""
        own = [0] * len(self.tags)
        for k, text in self.pieces:
            if k >= 0 and not out[k] and not self.link[k]:
                own[k] += len(text.strip())
        for k in range(len(own) - 1, 0, -1):
            own[self.parents[k]] += own[k]
        return own

    def _leave_out(self) -> None:
        """Take out what isn't the article by its tag, and readers' comments."""
        n, tags, parents = len(self.tags), self.tags, self.parents
        self.link = [False] * n
        for k in range(1, n):
            self.link[k] = self.link[parents[k]] or tags[k] == "a"
        never = self._below([tags[k] == "head" or self.marks[k] == 3 for k in range(n)])
        by_tag = self._below(list(self.out))
        holds = [False] * n  # a heading of the page, which no comment has
        for k in range(n - 1, 0, -1):
            holds[k] = holds[k] or tags[k] in ("h1", "main")
            holds[parents[k]] = holds[parents[k]] or holds[k]
        readers = self._below([self.marks[k] == 2 and not holds[k] for k in range(n)])
        out = [t or r for t, r in zip(by_tag, readers, strict=True)]
        left, size = self._unlinked(out), self._unlinked(never)
        # articles that aren't in others; comments may be articles, too
        articles = [k for k in range(n) if tags[k] in ("article", "main") and self.marks[k] != 2 and size[k] and not never[k]]
        known = set(articles)
        within = self._below([k in known for k in range(n)])
        outer = [k for k in articles if not within[parents[k]]]
        if outer and not any(left[k] for k in articles) and (not left[0] or len(outer) == 1 and size[outer[0]] > left[0]):
            # the only article is inside of what went: it stays, with what is around it
            best = max(outer, key=lambda k: (size[k], -k))
            inside = set(self._subtree(best))
            while best > 0:
                best = parents[best]
                inside.add(best)
            out = self._below([never[k] or (k not in inside and (self.out[k] or self.marks[k] == 2)) for k in range(n)])
        elif not left[0]:
            out = by_tag
        self.out = out

    def text(self) -> str:
        """The article's text: blocks in page order, with single blanks between words."""
        self._leave_out()
        tags, parents, out, link, n = self.tags, self.parents, self.out, self.link, len(self.tags)
        chars, link_chars = [0] * n, [0] * n
        for k, text in self.pieces:
            if k >= 0 and not out[k]:
                size = len(text.strip())
                chars[k] += size
                if link[k]:
                    link_chars[k] += size
        self._up(chars), self._up(link_chars)
        count, link_count = self._up([1] * n), self._up([int(t == "a") for t in tags])
        body = next((k for k in range(n) if tags[k] == "body"), 0)
        density, total, children = [0.0] * n, [0.0] * n, [0] * n
        share = link_chars[body] / (chars[body] or 1)
        lowered, sentences = [False] * n, [t in SENTENCES for t in tags]
        for k in range(1, n):
            lowered[k] = lowered[parents[k]] or self.marks[k] == 1
        for k in range(n - 1, -1, -1):
            if out[k] or not chars[k]:
                continue
            c, lc, t, lt = chars[k], link_chars[k], count[k], link_count[k]
            base = log(c / ((c - lc) or 1) * lc + share * c + e)
            density[k] = max(0.0, c / t * log(max(1.0, c / (lc or 1) * t / (lt or 1))) / base)
            if k:
                total[parents[k]] += density[k]
                children[parents[k]] += 1
                sentences[parents[k]] = sentences[parents[k]] or sentences[k]
        core = max((k for k in range(n) if not out[k]), key=lambda k: (total[k] / (LOWERED if lowered[k] else 1), -k), default=0)
        if not total[core]:
            core = body
        way, up = [core], core
        while up not in (0, body):
            up = parents[up]
            way.append(up)
        on_way, threshold = set(way), min(density[k] for k in way)
        around = [k for k in way if tags[k] == "article"] or [k for k in way if tags[k] == "main"]
        mostly_links = lambda k: 2 * link_chars[k] > chars[k]
        # what stands beside the way and reaches the threshold, by the element of the way that it is in
        dense = {}
        usual = total[core] / (children[core] or 1) / 2
        for k in range(1, n):
            if parents[k] in on_way and k not in on_way and chars[k] and not out[k]:
                own = total[k] / LOWERED if self.marks[k] == 1 else density[k]
                dense[k] = own >= (threshold if sentences[k] else max(threshold, usual)) and not mostly_links(k)
        if around:
            top = around[-1]
        else:
            beside = {parents[k] for k, d in dense.items() if d}
            top = next((k for k in reversed(way) if k in beside and k != core), core)
        inside = self._subtree(top)
        chosen = [False] * n
        for k in inside:
            if out[k]:
                continue
            if k == top or k in on_way:
                chosen[k] = True
            elif self.marks[k] == 1 and total[k] / LOWERED < threshold:
                continue
            elif not chosen[parents[k]]:
                continue
            elif around or parents[k] not in on_way or parents[k] == core:
                chosen[k] = True
            else:
                chosen[k] = dense.get(k, False) or tags[k] in PROSE | INLINE and not mostly_links(k)
        if not any(chosen[k] and text.strip() for k, text in self.pieces if k >= 0):
            chosen = [k in inside and not o for k, o in enumerate(out)]  # nothing but marked elements
        return " ".join("".join([" " if k < 0 else text for k, text in self.pieces if k < 0 or chosen[k]]).split())

    def _subtree(self, top: int) -> range:
        """The elements of a subtree, which stand one after another."""
        end, parents = top + 1, self.parents
        while end < len(parents) and parents[end] >= top:
            end += 1
        return range(top, end)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame, id_columns: tuple[str, ...] = ("page_id", "url"), html_column: str = "html") -> DataFrame:
    """``(*id_columns, text)``: the main text of each page, one row for each row of ``pages``.

    A null or empty page, and one without text outside of menus, forms and the like, gives an empty string. Every page is parsed to its end;
    nesting of any depth and unclosed markup are taken as they are. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    source = pages.select(*[F.col(c).alias(f"key{i}") for i, c in enumerate(id_columns)], F.col(html_column).cast("string").alias("html"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    done = source.mapInArrow(run, f"{fields}, text string")
    return done.select(*[F.col(f"key{i}").alias(c) for i, c in enumerate(id_columns)], "text")
