"""What a fetched page holds: title, language, headings, text, dates, links, and what kind of page it is.

One pass of a streaming parser over each page gives plain columns; everything
that follows from them is a built-in expression.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.functions.urls import collapsed_path

#: Meta keys, JSON-LD keys and attributes that hold a publication date.
META_KEYS = (
    "article:published_time", "og:published_time", "publish-date", "pubdate", "publication_date", "date", "dc.date", "dc.date.issued", "sailthru.date",
)
LINKED_DATA_KEYS = ("datepublished", "datecreated", "uploaddate")
DATE_ATTRIBUTES = ("datetime", "content", "data-date", "data-published", "data-datetime")
#: Headings kept; links that make a listing; scripts and characters of a page drawn by scripts.
MOST_HEADINGS, LISTING_LINKS, MANY_SCRIPTS, LITTLE_TEXT = 8, 8, 20, 3000
#: Names of index pages and words of section roots.
INDEX_NAMES = ("", "index", "index.html", "home", "home.html", "list", "listing", "search", "results")
SECTION_WORDS = ("recall", "alert", "rappel", "warnung", "meldung", "home")
#: Words in addresses of no interest.
NOISE = ("faq", "support", "privacy", "contact", "mentions-legales")
_HIDDEN = ("script", "style", "template")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lang = self.title = None
        self.open: list[str] = []
        self.texts: dict[str, list[str]] = {"all": [], "body": [], "main": []}
        self.headings: list[tuple[str, str, bool]] = []
        self.links: list[tuple[str, list[str]]] = []
        self.dates: list[tuple[str, str]] = []
        self.times: list[list[str]] = []
        self.scripts = 0
        self._title: list[str] = []
        self._linked: list[str] | None = None
        self._head: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        held = {k: v or "" for k, v in attrs}
        if tag == "html" and self.lang is None and held.get("lang", "").strip():
            self.lang = held["lang"].strip()
        elif tag == "a" and held.get("href"):
            self.links.append((held["href"], []))
        elif tag == "meta" and (held.get("property") or held.get("name") or "").strip().lower() in META_KEYS and held.get("content"):
            self.dates.append(("meta", held["content"]))
        elif tag == "script":
            self.scripts += 1
            self._linked = [] if "ld+json" in held.get("type", "").lower() else None
        elif tag in ("h1", "h2", "h3"):
            self._head = []
        elif tag == "time":
            self.times.append([])
        if "datetime" in held:
            self.dates += [("main" if "main" in self.open else "body", held[a]) for a in DATE_ATTRIBUTES if held.get(a)]
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        if tag == "script" and self._linked is not None:
            self.dates += [("meta", d) for d in linked_dates("".join(self._linked))]
            self._linked = None
        if tag in ("h1", "h2", "h3") and self._head is not None:
            self.headings.append((tag, " ".join(self._head), "main" in self.open))
            self._head = None
        if tag == "title" and self.title is None:
            self.title = " ".join(" ".join(self._title).split())
        while self.open.pop() != tag:
            pass

    def handle_data(self, data):
        if self._linked is not None:
            self._linked.append(data)
        if any(t in _HIDDEN for t in self.open):
            return
        if "title" in self.open and self.title is None:
            self._title.append(data)
            return
        text = data.strip()
        if not text:
            return
        for part in ("all", *(p for p in ("body", "main") if p in self.open)):
            self.texts[part].append(text)
        if self._head is not None:
            self._head.append(text)
        if "a" in self.open and self.links:
            self.links[-1][1].append(text)
        if "time" in self.open and self.times:
            self.times[-1].append(text)


def linked_dates(raw: str) -> list[str]:
    """Publication dates anywhere in a JSON-LD block; broken blocks give none."""
    try:
        todo = [json.loads(raw)]
    except (ValueError, RecursionError):
        return []
    found: list[str] = []
    while todo:
        node = todo.pop(0)
        if isinstance(node, dict):
            inner = []
            for key, value in node.items():
                if str(key).strip().lower() in LINKED_DATA_KEYS and isinstance(value, str):
                    found += [value.strip()] if value.strip() else []
                else:
                    inner.append(value)
            todo = inner + todo
        elif isinstance(node, list):
            todo = list(node) + todo
    return found


def resolved(base: str, href: str) -> str | None:
    """The absolute http address of a link without fragment and repeated path blocks; None if it is none."""
    try:
        parts = urlsplit(urldefrag(urljoin(base, href))[0])
    except ValueError:
        return None
    if parts.scheme not in ("http", "https"):
        return None
    return urlunsplit(parts._replace(path=collapsed_path(parts.path) if parts.path else ""))


FACTS = "url string, title string, lang string, headings array<string>, text string, date_values array<string>, time_texts array<string>, links array<struct<url:string,text:string>>, anchors int, scripts int"
_ARROW = pa.schema([
    ("url", pa.string()), ("title", pa.string()), ("lang", pa.string()), ("headings", pa.list_(pa.string())), ("text", pa.string()), ("date_values", pa.list_(pa.string())),
    ("time_texts", pa.list_(pa.string())), ("links", pa.list_(pa.struct([("url", pa.string()), ("text", pa.string())]))), ("anchors", pa.int32()), ("scripts", pa.int32()),
])


def facts_of(url: str, html: str) -> tuple:
    page = _Page()
    page.feed(html)
    page.close()
    root = next((p for p in ("main", "body") if page.texts[p]), "all")
    headings = [f"<{t}>{x}</{t}>" for t, x, inside in page.headings if inside or root != "main"][:MOST_HEADINGS]
    first = next((x for t, x, _ in page.headings if t == "h1" and x), None)
    links, seen = [], set()
    for href, text in page.links:
        target = resolved(url, href)
        if target and target not in seen:
            seen.add(target)
            links.append({"url": target, "text": " ".join(text)[:160]})
    dates = [v for where, v in page.dates if where == root or (where == "body" and root != "main")] + [v for where, v in page.dates if where == "meta"]
    times = [" ".join(x) for x in page.times if x]
    return url, page.title or first or url, page.lang, headings, " ".join(page.texts[root]), dates, times, links, len(page.links), page.scripts


def page_facts(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """The facts of every page (see FACTS); null and empty pages give a row with the address as title and nothing else."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [facts_of(u or "", h or "") for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)

    return pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(parse, FACTS)


def index_path(path: Column) -> Column:
    """A path that looks like an index: a root, an index name, or a shallow section without a long number."""
    p = F.regexp_replace(F.lower(path), "/+$", "")
    shallow = (F.size(F.filter(F.split(p, "/"), lambda x: x != "")) <= 3) & ~p.rlike(r"\d{4,}") & p.rlike("|".join(SECTION_WORDS))
    return (p == "") | p.rlike(r"_node(\.html)?$") | F.substring_index(p, "/", -1).isin(*INDEX_NAMES) | shallow


def page_class(url: Column, path: Column, anchors: Column, keywords: Column) -> Column:
    """listing, detail or irrelevant, by keywords in the address and the number of links."""
    wanted = F.exists(keywords, lambda k: F.contains(F.lower(url), F.lower(k)))
    many = anchors >= LISTING_LINKS
    return F.when(wanted & many & index_path(path), "listing").when(wanted, "detail").when(many, "listing").otherwise("irrelevant")


#: Marks of a page that a script fills.
SHELL_MARKERS = ("__next_data__", "enable javascript", "javascript is required", 'id="app"></div>', 'id="root"></div>')
#: Words in the title or path of a listing; links that make one with and without such a word.
LISTING_SIGNALS = (
    "recalls", "recall alerts", "food alerts", "food warnings", "latest warnings", "product warnings", "rappels", "alertes", "warnungen", "produktwarnungen",
)
LISTING_LEAST, LISTING_SURE = 3, 5


def needs_browser(html: Column, text: Column, least: int) -> Column:
    """The text is short or the page is a shell that a script fills."""
    low = F.lower(html)
    return (F.length(text) < least) | F.exists(F.array(*map(F.lit, SHELL_MARKERS)), lambda m: F.contains(low, m))


def is_listing(title: Column, path: Column, links: Column) -> Column:
    """Three links and a word of listings in title or path, or five links."""
    words = F.lower(F.concat_ws(" ", title, path))
    signal = F.exists(F.array(*map(F.lit, LISTING_SIGNALS)), lambda m: F.contains(words, m))
    return (links >= LISTING_LEAST) & (signal | (links >= LISTING_SURE))


def drawn_by_scripts(scripts: Column, html: Column) -> Column:
    return (scripts > MANY_SCRIPTS) & (F.length(F.trim(F.regexp_replace(html, r"\s+", " "))) < LITTLE_TEXT)


def crawl_points(url: Column, keywords: Column) -> Column:
    """Points of an address in the crawl: wanted words against noise."""
    low = F.lower(url)
    return F.when(F.exists(keywords, lambda k: F.contains(low, F.lower(k))), 12).otherwise(0) - F.when(low.rlike("|".join(NOISE)), 4).otherwise(0)
