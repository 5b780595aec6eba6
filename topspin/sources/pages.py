"""Pages as rows: one page of HTML gives many rows of links, table cells, headings or matches.

Parsing is a small helper of each task; everything after it (types, filters, joins, carried values) is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end others where they begin.
IMPLIED = frozenset("tr td th li p option".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order; without recursion, so that depth doesn't matter."""
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                yield x
                todo += reversed(x.children)

    def find(self, tag: str | None = None, mark: str | None = None) -> Iterator[Node]:
        """Elements below with that tag and a class that contains ``mark``."""
        return (n for n in self.walk() if (tag is None or n.tag == tag) and (mark is None or mark in n.attrs.get("class", "")))

    def text(self) -> str:
        out, todo = [], list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                todo += reversed(x.children)
        return " ".join(" ".join(out).split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.begin(tag, {k: v or "" for k, v in attrs})

    def begin(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in IMPLIED:
            up = self.at
            while up.parent is not None and up.tag not in ("table", "ul", "ol", "div", "select", "body"):
                if up.tag == tag or (tag == "tr" and up.tag in ("td", "th")) or (tag in ("td", "th") and up.tag in ("td", "th")):
                    self.at = up.parent
                up = up.parent
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        up = self.at
        while up.parent is not None and up.tag != tag:
            up = up.parent
        if up.parent is not None:
            self.at = up.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


#: Pages of nothing but text, quoted attributes and closed brackets, without references and without elements whose content is no markup; their pieces; attributes.
_PLAIN = re.compile(r'(?:[^<&]++|<(?!script|style|textarea|title|xmp|iframe|no|plaintext)[a-z][a-z0-9]*+(?: [a-z][a-z0-9-]*+="[^"&<>]*+")*+>|</[a-z][a-z0-9]*+>)*+')
_PIECE = re.compile(r"<(/?)([a-z][a-z0-9]*)([^>]*)>|([^<]+)")
_ATTRIBUTE = re.compile(r'([a-z][a-z0-9-]*)="([^"]*)"')


@lru_cache(4096)
def _attributes(text: str) -> dict[str, str]:
    return dict(_ATTRIBUTE.findall(text))


def parse(html: str | None) -> Node:
    """The tree of a page; plain pages, which a pattern can cut up, take a tenth of the time. Elements may share their attributes."""
    tree, html = _Tree(), html or ""
    if _PLAIN.fullmatch(html):
        at = tree.at
        for end, tag, attributes, data in _PIECE.findall(html):
            if data:
                at.children.append(data)
            elif end and at.tag == tag:
                at = at.parent
            elif end or tag in IMPLIED or tag in VOID:
                tree.at = at
                tree.handle_endtag(tag) if end else tree.begin(tag, _attributes(attributes))
                at = tree.at
            else:
                node = Node(tag, _attributes(attributes), at)
                at.children.append(node)
                at = node
        return tree.root
    tree.feed(html)
    tree.close()
    return tree.root


def extract(pages: DataFrame, rows_of: Callable[[Node], list[tuple]], columns: str, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """``(id_column, position, *columns)``: the rows that ``rows_of`` finds on each page. Null and broken pages give what can be found."""
    source = pages.select(F.col(id_column).alias("key"), F.col(html_column).cast("string").alias("html"))
    ddl = f"key {source.schema['key'].dataType.simpleString()}, position int, {columns}"
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str | None, list[tuple]] = {}  # equal pages of a batch are read once
            texts = batch.column("html").to_pylist()
            for html in texts:
                if html not in known:
                    known[html] = rows_of(parse(html))
            out = [(key, i, *row) for key, html in zip(batch.column("key").to_pylist(), texts, strict=True) for i, row in enumerate(known[html])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [batch.schema.field("key").type, pa.int32(), *types], strict=True)], names=["key", "position", *names])

    return source.mapInArrow(run, ddl).withColumnRenamed("key", id_column)


def links(pages: DataFrame, **columns: str) -> DataFrame:
    return extract(pages, lambda root: [(n.attrs.get("href", ""), n.text()) for n in root.find("a")], "href string, label string", **columns)


def headings(pages: DataFrame, references: str | None = None, **columns: str) -> DataFrame:
    """Headings and titles of pages. With ``references`` (a pattern of what stands between ``&`` and ``;``) only those character references are decoded, others and unfinished ones stay as they are written."""
    if references is not None:
        html = columns.get("html_column", "html")
        pages = pages.withColumn(html, F.regexp_replace(F.col(html).cast("string"), f"&(?!(?:{references});)", "&amp;"))
    return extract(pages, lambda root: [(n.tag, n.text()) for n in root.walk() if re.fullmatch("h[1-6]|title", n.tag)], "tag string, label string", **columns)


def cells(pages: DataFrame, **columns: str) -> DataFrame:
    def rows(root: Node) -> list[tuple]:
        return [(t, r, c, cell.text()) for t, table in enumerate(root.find("table")) for r, row in enumerate(table.find("tr")) for c, cell in enumerate(x for x in row.walk() if x.tag in ("td", "th"))]

    return extract(pages, rows, "table_number int, row_number int, cell_number int, label string", **columns)


_SEED = re.compile(r"^\s*[(\[](\d+|WC|Q|LL|PR|SE|ALT)[)\]]\s*|\s*[(\[](\d+|WC|Q|LL|PR|SE|ALT)[)\]]\s*$", re.I)


def match_rows(root: Node) -> list[tuple]:
    """Matches of a page's match tables: each has two rows, a name and a cell for each set.

    The winner is told by the table's class (``...winner-a``), else by the sets that are marked as won, else not.
    """
    out = []
    for table in root.find("table", "match-table"):
        sides = [r for r in table.find("tr") if any("set" in c.attrs.get("class", "") for c in r.walk() if c.tag == "td")][:2]
        if len(sides) < 2:
            continue
        people, won, games, ids = [], [], [], []
        for row in sides:
            name = next((c for c in row.walk() if c.tag in ("td", "a", "span") and ("player" in c.attrs.get("class", "") or "name" in c.attrs.get("class", ""))), row)
            sets = [c for c in row.walk() if c.tag == "td" and "set" in c.attrs.get("class", "")]
            people.append(_SEED.sub("", name.text()).strip())
            games.append([c.text() for c in sets])
            won.append(sum("is-winner" in c.attrs.get("class", "") for c in sets))
            href = next((a.attrs.get("href", "") for a in row.find("a")), "")
            ids.append(next(iter(re.findall(r"/players?/(\w+)", href)), None))
        marks = table.attrs.get("class", "")
        winner = "A" if "winner-a" in marks else "B" if "winner-b" in marks else "A" if won[0] > won[1] else "B" if won[1] > won[0] else None
        score = " ".join(f"{a}-{b}" for a, b in zip(*games, strict=False) if a and b)
        out.append((people[0], people[1], ids[0], ids[1], winner, score))
    return out


def match_tables(pages: DataFrame, **columns: str) -> DataFrame:
    return extract(pages, match_rows, "player_a string, player_b string, player_a_external_id string, player_b_external_id string, winner string, score string", **columns)


def profiles(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Facts on a player's page, out of its JSON-LD where it has one and else out of its text; expressions only."""
    html = F.col(html_column)
    data = F.regexp_extract(html, r'(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1)
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")
    part = lambda form: F.nullif(F.regexp_extract(text, form, 1), F.lit(""))
    return pages.select(
        id_column, F.try_to_date(F.get_json_object(data, "$.birthDate"), "yyyy-MM-dd").alias("birth_date"), F.get_json_object(data, "$.nationality").alias("nationality"),
        part(r"(\d{3})\s*cm").try_cast("int").alias("height_cm"), part(r"(?i)turned pro\D{0,10}(\d{4})").try_cast("int").alias("turned_pro_year"),
        F.initcap(part(r"(?i)(right|left)-handed")).alias("hand"), F.initcap(part(r"(?i)(one|two)-handed backhand")).alias("backhand"),
    )


def between_markers(rows: DataFrame, group: str, order: str, is_marker: Column) -> DataFrame:
    """``rows`` with ``section``: how many markers stand at or before a row of its page."""
    return rows.withColumn("section", F.count_if(is_marker).over(Window.partitionBy(group).orderBy(order)))


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files with front matter: ``(path, title, date, draft, body)``, newest first, drafts left out."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    head = F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)", 1)
    item = lambda key: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{key}:\s*(.*)$", 1), r"^['\"]|['\"]$", "")), F.lit(""))
    rows = files.select("path", item("title").alias("title"), F.try_to_date(item("date"), "yyyy-MM-dd").alias("date"), F.coalesce(F.lower(item("draft")) == "true", F.lit(False)).alias("draft"), F.regexp_replace("value", r"(?s)^---\s*\n.*?\n---\s*(\n|$)", "").alias("body"))
    return rows.where(~F.col("draft")).orderBy(F.col("date").desc_nulls_last(), "path")
