"""HTML sections of books and pages: one pass over parser events, then labelled chunks with page, chapter and section.

The events of a section become two flat tables in memory: its elements in document order, each with the range of elements
and strings inside it, and its strings. What the walk asks (is there text inside, a block, a superscript) is answered from
running counts over these ranges, so a section costs time in proportion to its size at any depth of nesting, without
recursion. The leaves, the innermost pieces of running text, are then attributed by a small state machine.

One Arrow function does this for a section and returns its chunks as an array; all else (skipping, numbering, exploding,
assembling) is relational. Sections are independent of each other.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.operators import chunks as C

# Names and classes that the walk knows.
VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
BLOCKS = frozenset(["p", *(f"h{n}" for n in range(1, 9))])
TITLE_MARKS = ("title", "chtitle", "tochead", "title1", "h1_label")
TOP_HEADER_CLASSES = ("pre-title1", "h")
CHAPTER_NUMBER_CLASSES = ("chno", "ch-num")
OWN_TEXT = frozenset(["script", "style", "template"])
DEEPEST_HEADER = 5
ROMAN = re.compile(r"(?i)^(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")
#: Kinds of strings beside those of OWN_TEXT.
PLAIN, BREAK, HIDDEN = "", "br", "!"


# ---- events to flat tables ----


class Section(HTMLParser):
    """Elements and strings of a section. Nothing is closed but by its own end tag; an end tag without a start is ignored.

    Element k has names[k], attrs[k], up[k], holds elements k + 1 .. last[k] - 1 and strings first[k] .. end[k] - 1. Element
    0 is the section itself. A string is (kind, value, element)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.names, self.attrs, self.up, self.last, self.first, self.end = ["[document]"], [{}], [-1], [0], [0], [0]
        self.strings: list[tuple[str, str, int]] = []
        self.path, self.open_names = [0], {"[document]": 1}
        self.feed(html)
        self.close()
        self._shut(0)
        count = lambda marks: list(accumulate(marks, initial=0))
        self.blocks = count(name in BLOCKS for name in self.names)
        self.solid = count(kind == PLAIN and not value.isspace() for kind, value, _ in self.strings)
        self.sups = [k for k, name in enumerate(self.names) if name == "sup"]
        self.anchors = [k for k, name in enumerate(self.names) if name in ("a", "span") and self.attrs[k].get("id")]

    def _shut(self, depth: int) -> None:
        for k in self.path[depth:]:
            self.last[k], self.end[k] = len(self.names), len(self.strings)
            self.open_names[self.names[k]] -= 1
        del self.path[depth:]

    def _add(self, name: str, attrs) -> None:
        for column, value in ((self.names, name), (self.attrs, {k: v or "" for k, v in attrs}), (self.up, self.path[-1]), (self.last, len(self.names) + 1), (self.first, len(self.strings)), (self.end, len(self.strings))):
            column.append(value)
        if name == "br":
            self.strings.append((BREAK, " ", self.path[-1]))

    def handle_starttag(self, name, attrs):
        self._add(name, attrs)
        if name not in VOID:
            self.path.append(len(self.names) - 1)
            self.open_names[name] = self.open_names.get(name, 0) + 1

    def handle_startendtag(self, name, attrs):
        self._add(name, attrs)

    def handle_endtag(self, name):
        if self.open_names.get(name) and name != "[document]":
            depth = len(self.path) - 1
            while self.names[self.path[depth]] != name:
                depth -= 1
            self._shut(depth)  # what was looked through is closed

    def handle_data(self, data):
        own = self.names[self.path[-1]]
        self.strings.append((own if own in OWN_TEXT else PLAIN, data, self.path[-1]))

    def handle_comment(self, data):
        self.strings.append((HIDDEN, data, self.path[-1]))

    handle_decl = handle_comment

    def has_text(self, k: int) -> bool:
        if self.names[k] in OWN_TEXT:
            return any(kind == self.names[k] and value.strip() for kind, value, _ in self.strings[self.first[k] : self.end[k]])
        return self.solid[self.end[k]] > self.solid[self.first[k]]

    def text(self, k: int, without: list[tuple[int, int]] = (), breaks: bool = True) -> str:
        """The text of an element, without some ranges of strings."""
        kinds = (self.names[k],) if self.names[k] in OWN_TEXT else (PLAIN, BREAK) if breaks else (PLAIN,)
        inside = range(self.first[k], self.end[k])
        if without:
            inside = [x for x in inside if not any(a <= x < b for a, b in without)]
        return "".join([self.strings[x][1] for x in inside if self.strings[x][0] in kinds])

    def within(self, of: list[int], k: int) -> list[int]:
        """Those of a sorted list of elements that element k holds."""
        return of[bisect_left(of, k + 1) : bisect_left(of, self.last[k])]

    def leaves(self) -> Iterator[int]:
        """Elements with text and no block inside, in order; divs and the section itself are always opened."""
        k = 0
        while k < len(self.names):
            whole = self.names[k] != "div" and self.has_text(k) and self.blocks[self.last[k]] == self.blocks[k + 1]
            if whole:
                yield k
            k = self.last[k] if whole else k + 1

    def notes(self, k: int) -> list[int]:
        """The superscripts of a leaf that mark notes: all but those that are its whole first content, what was taken out
        before not counted."""
        gone: list[int] = []
        for sup in self.within(self.sups, k):
            cut = [(self.first[g], self.end[g]) for g in gone]
            if not self._leads(sup, k, gone, cut):
                gone.append(sup)
        return gone

    def _leads(self, sup: int, leaf: int, gone: list[int], cut: list[tuple[int, int]]) -> bool:
        start = next((x for x in range(self.first[leaf], self.end[leaf]) if self.strings[x][2] == leaf and self.strings[x][1].strip() and not any(a <= x < b for a, b in cut)), self.end[leaf])
        children = (c for c in self._children(leaf) if c not in gone)
        top = next(children, None)
        if top is None or start < self.first[top]:
            return False  # its own words come first
        if not (top <= sup < self.last[top] or any(self._same(sup, s) for s in ([top] if self.names[top] == "sup" else []) + self.within(self.sups, top) if s not in gone)):
            return False
        return self.text(sup, cut).strip() == self.text(top, cut).strip()

    def _children(self, k: int) -> Iterator[int]:
        c = k + 1
        while c < self.last[k]:
            yield c
            c = self.last[c]

    def _same(self, a: int, b: int) -> bool:
        """Equal in all that they hold."""
        shape = lambda k: ([(self.names[x], self.attrs[x], self.up[x] - k) for x in range(k, self.last[k])][1:], self.attrs[k], [(kind, value, e - k) for kind, value, e in self.strings[self.first[k] : self.end[k]]])
        return shape(a) == shape(b)


# ---- what an element is ----


def enhanced(title: str) -> str:
    """functions.text.enhance_title for one string."""
    t = title.strip()
    if not t.isupper() or ROMAN.match(t):
        return t
    head, _, _ = t.partition(" ")
    out = head + t[len(head) :].title() if head != t and ROMAN.match(head) else t.title()
    return out.replace("'S", "'s").replace("’S", "’s")


_LEVEL = re.compile(r"[hH](\d+)\Z")


def header_level(name: str, classes: list[str] = ()) -> int | None:
    """By name, or by the first class that says so; 0 is above h1."""
    said = (0 if c.lower() in TOP_HEADER_CLASSES else int(m[1]) if (m := _LEVEL.match(c)) else None for c in classes)
    own = _LEVEL.match(name)
    return int(own[1]) if own else next((level for level in said if level is not None), None)


def is_title(classes: list[str]) -> bool:
    return any(c.lower().startswith(TITLE_MARKS) or c.lower().endswith(TITLE_MARKS) for c in classes)


def is_chapter_number(classes: list[str], text: str) -> bool:
    return text.isdigit() and any(c in CHAPTER_NUMBER_CLASSES for c in classes)


def is_only_h1(level: int | None, h1_count: int) -> bool:
    return level == 1 == h1_count


def is_section_title(leaf: Leaf | None) -> bool:
    return leaf is not None and (leaf.title or leaf.number or leaf.level is not None)


def page_of_mark(mark: str) -> str:
    """The page that the id of an anchor names; Roman numbers stay as they are."""
    if mark.startswith("page_"):
        return mark.rsplit("_", 1)[-1]
    return mark[1:] if mark[:1] == "p" and mark[1:].isdigit() else ""


def page_of_element(mark: str) -> str:
    """The page that the id of a paragraph names, if it is a number."""
    number = mark[1:].split("-")[0].strip().lstrip("+") if mark[:1] == "p" else ""
    return str(int(number)) if number.isdecimal() else ""


@dataclass(slots=True)
class Leaf:
    name: str
    text: str
    level: int | None
    title: bool
    number: bool
    page: str

    @classmethod
    def of(cls, section: Section, k: int, remove_footnotes: bool = True) -> Leaf:
        gone = section.notes(k) if remove_footnotes else []
        text = section.text(k, [(section.first[g], section.end[g]) for g in gone])
        classes = section.attrs[k].get("class", "").split()
        marks = [section.attrs[a]["id"] for a in section.within(section.anchors, k) if not any(g <= a < section.last[g] for g in gone)]
        named = [page_of_mark(m) for m in marks if m.startswith("page_") or page_of_mark(m)]
        page = (named[-1] if named else "") or page_of_element(section.attrs[k].get("id", ""))
        return cls(section.names[k], text, header_level(section.names[k], classes), is_title(classes), is_chapter_number(classes, text), page)


# ---- attribution ----


@dataclass(slots=True)
class Heading:
    """What the first leaves of a section say about it: known is the leaf that names it, body the first leaf that can end
    the head. Everything follows from these two places."""

    title: str = ""
    number: int = 0
    page: str = ""
    taken: frozenset[int] = frozenset()

    @classmethod
    def of(cls, found: list[Leaf], sole: frozenset[int]) -> Heading:
        names = lambda x: x.title or (not x.number and x.name != "p" and x.level in sole)
        known = next((k for k, x in enumerate(found) if names(x) and enhanced(x.text)), len(found))
        body = next((k for k, x in enumerate(found) if x.name == "p" and not x.title and not x.number and k > min(known, 2)), len(found))
        titles = [k for k, x in enumerate(found[:body]) if x.title]
        parts = [k for k in ([known] if known < body else []) + titles if k >= known]
        return cls(
            title=": ".join(enhanced(found[k].text) for k in dict.fromkeys(parts)),
            number=next((int(x.text) for x in reversed(found[:body]) if x.number and not x.title), 0),
            page=next((x.page for x in reversed(found[: body + 1]) if x.page), ""),
            taken=frozenset(titles),
        )


def sole_levels(section: Section) -> frozenset[int]:
    """Levels whose header, being the only one, names the section: h1, or without any h1 the h2 and h3."""
    classes = lambda k: section.attrs[k].get("class", "").split()
    h1 = sum(name == "h1" and not is_title(classes(k)) and not is_chapter_number(classes(k), section.text(k, breaks=False)) for k, name in enumerate(section.names))
    if h1:
        return frozenset({1} if h1 == 1 else ())
    return frozenset(n for n in (2, 3) if section.names.count(f"h{n}") == 1)


@dataclass(slots=True)
class Outline:
    """State of the walk: the open headers from the top down, and what is known of chapter and page."""

    heading: Heading
    page: str
    title: str
    headers: list[tuple[int, str]] = field(default_factory=list)
    after_header: bool = False
    out: list[tuple[str, str, dict[str, str]]] = field(default_factory=list)

    def header(self, leaf: Leaf) -> None:
        """Deeper headers are closed; headers of one level right after each other are one."""
        while self.headers and self.headers[-1][0] > leaf.level:
            self.headers.pop()
        name = enhanced(leaf.text)
        if not name:
            return
        before = self.headers.pop()[1] if self.headers and self.headers[-1][0] == leaf.level else ""
        self.headers.append((leaf.level, f"{before}: {name}" if before and self.after_header else name))
        self.after_header = True
        self.out.append((name, "section_header", {"section_name": name}))

    def words(self, leaf: Leaf) -> None:
        self.after_header = False
        if not self.title and self.headers and self.headers[0][0] == 0:
            self.title = self.headers[0][1]
        if leaf.text:
            said = {"page_#": self.page, "chapter_title": self.title, "chapter_#": str(self.heading.number or ""),
                    "section_name": "".join(name for _, name in self.headers[:1]), "subsection_name": ": ".join(name for _, name in self.headers[1:])}
            self.out.append((leaf.text, "text", {key: value for key, value in said.items() if value}))

    def event(self, leaf: Leaf) -> None:
        self.page = leaf.page or self.page
        if not leaf.number:
            (self.words if leaf.level is None or leaf.level > DEEPEST_HEADER else self.header)(leaf)


def section_chunks(html: str, remove_footnotes: bool = True) -> list[tuple[str, str, dict[str, str]]]:
    """(text, label, meta) of each chunk of a section."""
    section = Section(html)
    found = [Leaf.of(section, k, remove_footnotes) for k in section.leaves()]
    heading = Heading.of(found, sole_levels(section))
    state = Outline(heading, heading.page, heading.title)
    if heading.title:
        state.out.append((heading.title, "section_header", {"chapter_title": heading.title}))
    for k, leaf in enumerate(found):
        if k not in heading.taken:
            state.event(leaf)
    return state.out


_CHUNKS = "array<struct<text:string,label:string,meta:map<string,string>>>"


def walk(sections: DataFrame, html: str = "html", remove_footnotes: bool = True) -> DataFrame:
    """The frame with column chunks in place of the html."""

    @F.pandas_udf(_CHUNKS)
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "label": label, "meta": meta} for t, label, meta in section_chunks(h or "", remove_footnotes)] for h in column])

    return sections.withColumn("chunks", run(F.col(html))).drop(html)


#: Items of a book that one window sorts; what is before them comes from counts.
STRETCH = 1 << 16


def _numbers(items: DataFrame) -> DataFrame:
    """Keys of the items with item_no from 1 in each book. A book of very many items is cut into stretches of item_seq."""
    keys = items.select("book_id", "item_seq", "item_id").withColumn("stretch", F.floor(F.col("item_seq") / STRETCH))
    before = F.sum("n").over(W.partitionBy("book_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    counts = keys.groupBy("book_id", "stretch").agg(F.count("*").alias("n")).select("book_id", "stretch", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("book_id", "stretch").orderBy("item_seq", "item_id"))
    return keys.withColumn("own", own).join(counts, ["book_id", "stretch"]).select("book_id", "item_seq", "item_id", (F.col("before") + F.col("own")).cast("int").alias("item_no"))


def _unskipped(items: DataFrame, skip: DataFrame | None) -> DataFrame:
    return items if skip is None else items.join(skip.select("book_title", "item_id").distinct(), ["book_title", "item_id"], "left_anti")


def numbered_items(items: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Items that are not skipped, with item_no from 1 in each book. Numbers are made from the keys alone."""
    items = _unskipped(items, skip)
    return items.join(_numbers(items), ["book_id", "item_seq", "item_id"])


def to_chunks(items: DataFrame, skip: DataFrame | None = None, meta: dict[str, str] | None = None) -> DataFrame:
    """items: book_id, book_title, item_seq, item_id, html. Sections are skipped before they are parsed, and numbered after
    it, so the html is not exchanged."""
    items = _unskipped(items, skip)
    df = walk(items).join(_numbers(items), ["book_id", "item_seq", "item_id"]).select("*", F.posexplode("chunks").alias("seq", "c"))
    base = F.create_map(*(F.lit(x) for pair in (meta or {}).items() for x in pair)) if meta else C.no_meta()
    own = F.create_map(F.lit("book_title"), F.col("book_title"), F.lit("item_id"), F.col("item_id"), F.lit("item_#"), F.col("item_no").cast("string"))
    return df.select(F.col("book_id").alias("doc_id"), F.col("item_no").alias("section_no"), "seq", F.col("c.text").alias("text"), F.col("c.label").alias("label"), C.merge_meta(C.merge_meta(base, own), F.col("c.meta")).alias("meta"))


def body_html(html):
    """What is inside the body of a page, or all of it."""
    inner = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)(</body\s*>|\z)", 1)
    return F.when(html.rlike(r"(?i)<body[\s>]"), inner).otherwise(html)


def from_pages(pages: DataFrame) -> DataFrame:
    """Pages as items: the host is the book, the page an item of it."""
    host = F.regexp_extract("url", r"^\w+://([^/]+)", 1)
    return pages.select(F.xxhash64(host).alias("book_id"), host.alias("book_title"), F.col("page_id").cast("bigint").alias("item_seq"), F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("item_id"), body_html(F.col("html")).alias("html"))
