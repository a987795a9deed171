"""Scanning of HTML pages: a linear tokenizer, and what the index takes from a page."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from siftwell.functions.arrays import in_slices

#: Where pages hold links.
LINK_PLACES = {("img", "src"), ("a", "href"), ("frame", "src"), ("link", "href"), ("script", "src"), ("table", "background"), ("body", "background"), ("area", "href")}
TITLE_CHARS = 60

#: From a tag's name to its end; a quoted value may hold ">". Atomic, so a failure costs one pass.
TAG_REST = re.compile(r"""((?>[^>=]+|=\s*+(?:"[^"]*"|'[^']*')|=)*+)>""")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>"']++))?""")
ENTITY = re.compile(r"&(?:[A-Za-z][-.A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);?")


def attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts, one without a value is empty."""
    found: dict[str, str] = {}
    for name, value in ATTR.findall(text):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return found


def scan(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name or text, attributes, end) of texts, opening ("<") and closing ("/") tags.

    Comments and declarations are left out. A place that is sent goes on from there. A ``<`` that
    begins no tag, and what follows one that no ``>`` ends, is text.
    """
    at = begin = 0  # text from ``begin`` on is not yet out
    loose = False  # quotes no longer count, once they have run to the end of the page
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        closing = page.startswith("/", at + 1)
        if page.startswith(("!", "?"), at + 1):
            mark, skip = ("-->", 4) if page.startswith("<!--", at) else (">", 2)
            end = page.find(mark, at + skip)
            if at > begin:
                yield "text", page[begin:at], "", at
            at = begin = len(page) if end < 0 else end + len(mark)
            continue
        name = NAME.match(page, at + 1 + closing)
        if not name:
            at += 1
            continue
        rest = None if loose else TAG_REST.match(page, name.end())
        if not rest:
            loose, close = True, page.find(">", name.end())
            if close < 0:
                break
        inside, end = (rest[1], rest.end()) if rest else (page[name.end() : close], close + 1)
        if at > begin:
            yield "text", page[begin:at], "", at
        sent = yield "/" if closing else "<", name[0].lower(), inside, end
        at = begin = end if sent is None else sent
        if sent is not None:
            yield "skip", "", "", sent
    if begin < len(page):
        yield "text", page[begin:], "", len(page)


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page, kind "/>" for an element without content; texts come without entities."""
    parts = scan(page)
    raw_end = None
    for kind, value, inside, end in parts:
        if kind == "text":
            for piece in ENTITY.split(value):
                if piece:
                    yield "text", piece, ""
        elif kind == "<":
            empty = inside.endswith("/")
            yield "/>" if empty else "<", value, inside.rstrip("/") if empty else inside
            if value in ("script", "style") and not empty:
                raw_end = re.compile(rf"</{value}\s*>", re.I).search(page, end)
                stop = raw_end.start() if raw_end else len(page)
                if stop > end:
                    yield "text", page[end:stop], ""
                parts.send(stop)
        elif kind == "/":
            yield "/", value, ""


def parse_page(page: str) -> tuple[str, str, list[str]]:
    """(title, text, link targets): text from <body> on, a blank for each end tag, pieces on lines of their own."""
    title, pieces, links = [], [], []
    in_title = in_body = False
    for kind, value, inside in events(page):
        if kind == "text":
            if in_title:
                title.append(value)
            elif in_body:
                pieces.append(value)
            continue
        if kind != "/":
            in_title |= value == "title"
            in_body |= value == "body"
            if value == "a" and (target := attributes(inside).get("href")):
                links.append(target)
        if kind != "<":
            in_title &= value != "title"
            pieces.append(" ")
    return "".join(title), "\n".join(pieces), links


def parse_clean(page: str) -> tuple[str, str, list[str]]:
    """(title or first 60 characters, text without scripts and styles, distinct link targets without fragments)."""
    open_tags: list[str] = []
    depth: dict[str, int] = {}  # how often each name is open
    title, pieces, links = "", [], {}
    for kind, value, inside in events(page):
        top = open_tags[-1] if open_tags else None
        if kind == "text":
            if top == "title":
                title = value
            elif top not in (None, "script", "style"):
                pieces += value.split()
        elif kind == "<":
            open_tags.append(value)
            depth[value] = depth.get(value, 0) + 1
            links.update({target.partition("#")[0]: None for name, target in attributes(inside).items() if (value, name) in LINK_PLACES})
        elif kind == "/" and depth.get(value):
            while True:
                gone = open_tags.pop()
                depth[gone] -= 1
                if gone == value:
                    break
    text = " ".join(pieces)
    return title or (text if len(text) < TITLE_CHARS else text[:TITLE_CHARS] + "..."), text, list(links)


def page_udf(parse: Callable[[str], tuple]):
    kind = Y.StructType([Y.StructField("title", Y.StringType()), Y.StructField("text", Y.StringType()), Y.StructField("links", Y.ArrayType(Y.StringType()))])
    types = {"title": pa.string(), "text": pa.string(), "links": pa.list_(pa.string())}

    @F.arrow_udf(kind)
    def run(pages: pa.Array) -> pa.Array:
        return in_slices(lambda p: (None, None, None) if p is None else parse(p), types, pages)

    return run


extract_html = page_udf(parse_page)
extract_html_clean = page_udf(parse_clean)
