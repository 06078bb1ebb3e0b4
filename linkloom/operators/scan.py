"""Scanners of HTML, CSS and robots.txt, as Arrow-batched functions over bytes.

Offsets are bytes of the UTF-8 body.  Project a scan once and explode it: Catalyst would otherwise repeat the function
for every field that is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.codec import decode_entities_text, refresh_text, rel_text, srcset_text
from linkloom.functions.text import SPACE
from linkloom.schemas import struct

LINK = struct("offset int, length int, value string, role string, tag string, attr string, hint string")
SCAN = T.StructType().add("links", T.ArrayType(LINK)).add("base_href", T.StringType()).add("head_end", T.IntegerType())
CSS_LINK = struct("offset int, length int, value string, is_import boolean")
#: A reference inside a link: part numbers the references of one link; at, size: its place in the link's decoded value.
REF = struct("link int, offset int, length int, role string, hint string, part int, at int, size int, ref string, descriptor string")
REFS = T.StructType().add("base_href", T.StringType()).add("refs", T.ArrayType(REF))
RULE = struct("pattern string, allow boolean")
ROBOTS = T.StructType().add("rules", T.ArrayType(RULE)).add("sitemaps", T.ArrayType(T.StringType())).add("crawl_delay_ms", T.LongType())

# Attributes that hold one URL: element, attribute, role, kind.
ATTRIBUTES = [
    ("a", "href", "navigation", "html"), ("area", "href", "navigation", "html"), ("iframe", "src", "navigation", "html"),
    ("frame", "src", "navigation", "html"), ("form", "action", "navigation", "html"),
    ("img", "src", "asset", "image"), ("img", "lowsrc", "asset", "image"), ("image", "href", "asset", "image"), ("input", "src", "asset", "image"),
    ("script", "src", "asset", "js"), ("embed", "src", "asset", "other"), ("object", "data", "asset", "other"),
    ("source", "src", "asset", "media"), ("track", "src", "asset", "other"), ("video", "src", "asset", "media"), ("video", "poster", "asset", "image"),
    ("audio", "src", "asset", "media"), ("use", "href", "asset", "image"), ("use", "xlink:href", "asset", "image"), ("image", "xlink:href", "asset", "image"),
    ("body", "background", "asset", "image"), ("table", "background", "asset", "image"), ("td", "background", "asset", "image"),
    ("img", "srcset", "srcset", "image"), ("source", "srcset", "srcset", "image"),
]
# Elements whose content is text, and properties of meta elements that hold an image.
RAW_TEXT = (b"script", b"style", b"textarea", b"title", b"xmp", b"noframes", b"iframe")
META_IMAGES = ("og:image", "og:image:url", "twitter:image", "og:video", "og:audio", "msapplication-tileimage")

_RULES: dict[bytes, list[tuple[bytes, str, str]]] = {}
for _tag, _attr, _role, _kind in ATTRIBUTES:
    _RULES.setdefault(_tag.encode(), []).append((_attr.encode(), _role, _kind))

_S = rb"[ \t\r\n\f]"
_MARKUP = re.compile(rb"<(?:!--.*?(?:-->|\Z)|[!/][^>]*(?:>|\Z)|([A-Za-z_:][^ \t\r\n\f>/]*))", re.S)
_ATTRIBUTE = re.compile(
    rb"([ \t\r\n\f/]*)(?:(>)|\Z|=|([^ \t\r\n\f=>/]+)" + _S + rb"*(?:=" + _S + rb"*(?:\"([^\"]*)\"?|'([^']*)'?|([^ \t\r\n\f>]*)))?)"
)
_CLOSERS = {t: re.compile(rb"</" + t + rb"(?=[ \t\r\n\f>/]|\Z)", re.I) for t in (*RAW_TEXT, b"head")}
_CSS = re.compile(
    rb"/\*.*?(?:\*/|\Z)"
    rb"|@import[ \t\r\n\f]*(?:\"(?P<i1>(?:\\.|[^\"])*)\"?|'(?P<i2>(?:\\.|[^'])*)'?)"
    rb"|@import"
    rb"|(?<![A-Za-z0-9_-])url[ \t\r\n\f]*\([ \t\r\n\f]*(?:\"(?P<u1>(?:\\.|[^\"])*)\"?|'(?P<u2>(?:\\.|[^'])*)'?|(?P<u3>(?:\\.|[^) \t\r\n\f])*))"
    rb"|\"(?:\\.|[^\"])*\"?|'(?:\\.|[^'])*'?",
    re.S | re.I,
)
#: What may turn out to begin one of these when more bytes come.
_CSS_PART = re.compile(rb"(?:/|@(?:i(?:m(?:p(?:or?)?)?)?)?|u(?:r(?:l[ \t\r\n\f]*)?)?)\Z", re.I)


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _lower(data: bytes) -> bytes:
    return data.lower()  # bytes fold ASCII only


class _Resumable:
    """A scanner that is fed a body in chunks: what it can't decide yet is held back, and offsets are those of the whole body."""

    def __init__(self) -> None:
        self.origin = 0  # the offset of the held bytes
        self._held, self._from, self._skip = b"", 0, b""

    def _keep(self, data: bytes, at: int, context: int = 0) -> None:
        start = max(0, at - context)
        self.origin, self._held, self._from = self.origin + start, data[start:], at - start

    def _skipped(self, data: bytes, at: int) -> int | None:
        """Where that ends which is passed over, or nothing if its end isn't here."""
        if not self._skip:
            return at
        found = data.find(self._skip, at)
        if found < 0:
            return None
        at, self._skip = found + len(self._skip), b""
        return at


class CssScanner(_Resumable):
    """offset, length, value, is_import of each URL of a style sheet, none of them in comments or strings.  A comment is never held whole."""

    def feed(self, chunk: bytes, last: bool = False) -> list[tuple[int, int, str, bool]]:
        css, at, out = self._held + chunk, self._from, []
        while (start := self._skipped(css, at)) is not None:
            at = start
            m = _CSS.search(css, at)
            if m is None:
                part = None if last else _CSS_PART.search(css, at)
                self._keep(css, part.start() if part else len(css), 1)
                return out
            if not last and m[0].startswith(b"/*"):
                if len(m[0]) < 4 or not m[0].endswith(b"*/"):
                    self._skip, at = b"*/", m.start() + 2
                    continue
            elif not last and (m.end() == len(css) or (m.lastgroup is None and m[0][:1] == b"@" and not css[m.end() :].strip(SPACE.encode()))):
                self._keep(css, m.start(), 1)
                return out
            at = m.end()
            if (k := m.lastgroup) and m.end(k) > m.start(k):
                value = re.sub(r"(?s)\\(.)", r"\1", _text(m[k]))
                out.append((self.origin + m.start(k), m.end(k) - m.start(k), value.strip(SPACE) if k == "u3" else value, k[0] == "i"))
        self._keep(css, max(at, len(css) - len(self._skip) + 1))
        return out


def css_links(css: bytes) -> list[tuple[int, int, str, bool]]:
    """offset, length, value, is_import of each URL, none of them in comments or strings."""
    return CssScanner().feed(css, last=True)


def _attributes(html: bytes, at: int) -> tuple[dict[bytes, tuple[int, int] | None], bool, int, bool]:
    """Of a tag whose name ends at a place: the spans of its values, whether it has a slash, where it ends, and whether its > is there."""
    spans: dict[bytes, tuple[int, int] | None] = {}
    closed = False
    while at < len(html):
        a = _ATTRIBUTE.match(html, at)
        at = a.end()
        closed |= b"/" in a[1]
        if a[2]:
            return spans, closed, at, True
        if a[3]:
            k = next((k for k in (4, 5, 6) if a[k] is not None), None)
            spans.setdefault(_lower(a[3]), a.span(k) if k else None)
    return spans, closed, at, False


def _roles(html: bytes, tag: bytes, spans: dict[bytes, tuple[int, int] | None]) -> Iterator[tuple[bytes, str, str, tuple[int, int] | None]]:
    """attribute, role, kind and span of what a tag may refer to."""

    def raw(name: bytes) -> bytes:
        span = spans.get(name)
        return b"" if span is None else html[span[0] : span[1]]

    if tag == b"base":
        yield b"href", "base", "other", spans.get(b"href")
    elif tag == b"link":
        kind, fetch = rel_text(_text(raw(b"rel"))) if b"rel" in spans else ("other", False)
        yield b"href", "asset" if fetch else "navigation", kind, spans.get(b"href")
    elif tag == b"meta" and (content := spans.get(b"content")):
        if _lower(raw(b"http-equiv").strip(SPACE.encode())) == b"refresh":
            text = raw(b"content").decode("latin-1")  # a byte a character, so places in it are bytes
            if span := refresh_text(text):
                yield b"content", "meta_refresh", "html", (content[0] + span[0], content[0] + span[1])
        if _text(_lower(raw(b"property" if b"property" in spans else b"name"))) in META_IMAGES:
            yield b"content", "asset", "image", content
    for name, role, kind in _RULES.get(tag, ()):
        yield name, role, kind, spans.get(name)
    yield b"style", "inline_style", "css", spans.get(b"style")


class HtmlScanner(_Resumable):
    """The links of a page, fed in chunks.  Text, comments and declarations are passed over; a tag, or a text element such as style, is
    held until its end is there (an unclosed text element therefore until the last chunk, when it turns out to be markup).

    base: the last base's href so far; heads: where the tags of head elements end; blocks: the bytes of the style blocks that the last feed gave, by offset.
    """

    def __init__(self) -> None:
        super().__init__()
        self.base: str | None = None
        self.heads: list[int] = []
        self.blocks: dict[int, bytes] = {}
        self._raw, self._sought = b"", 0

    def feed(self, chunk: bytes, last: bool = False) -> list[tuple]:
        html, at = self._held + chunk, self._from
        links: list[tuple] = []
        self.blocks = {}
        while (start := self._skipped(html, at)) is not None:
            at = start
            if self._raw:
                close = _CLOSERS[self._raw].search(html, at + self._sought)
                if not last and (close is None or close.end() == len(html)):
                    self._sought = max(0, len(html) - at - len(self._raw) - 2)
                    self._keep(html, at)
                    return links
                end = close.start() if close else at
                if self._raw == b"style" and end > at:
                    self.blocks[self.origin + at] = html[at:end]
                    links.append((self.origin + at, end - at, _text(html[at:end]), "style_block", "style", "", "css"))
                at, self._raw, self._sought = end, b"", 0
            m = _MARKUP.search(html, at)
            if m is None:
                self._keep(html, len(html) - (not last and at < len(html) and html.endswith(b"<")))
                return links
            if m[1] is None:
                at = m.end()
                if last or (len(m[0]) > 6 and m[0].endswith(b"-->") if m[0].startswith(b"<!--") else m[0].endswith(b">")):
                    continue
                if m[0].startswith(b"<!--"):
                    self._skip, at = b"-->", m.start() + 4
                elif b"<!--".startswith(m[0]):  # a comment, or not
                    self._keep(html, m.start())
                    return links
                else:
                    self._skip = b">"
                continue
            tag = _lower(m[1])
            spans, closed, end, ended = _attributes(html, m.end())
            if not ended and not last:
                self._keep(html, m.start())
                return links
            at, found = end, []
            for name, role, kind, span in _roles(html, tag, spans):
                if span is None:
                    continue
                value = decode_entities_text(_text(html[span[0] : span[1]]))
                if role == "base":
                    self.base = value
                if span[1] > span[0]:
                    found.append((self.origin + span[0], span[1] - span[0], value, role, _text(tag), _text(name), kind))
            links += sorted(found, key=lambda x: x[0])
            if tag in RAW_TEXT and not closed:
                self._raw = tag
            if tag == b"head":
                self.heads.append(self.origin + at)
        self._keep(html, max(at, len(html) - len(self._skip) + 1))
        return links


def html_links(html: bytes) -> tuple[list[tuple], str | None, int | None]:
    """The links by offset, the base's href, and where </head> is."""
    scanner = HtmlScanner()
    links = scanner.feed(html, last=True)
    ends = [close.start() for p in scanner.heads if (close := _CLOSERS[b"head"].search(html, p))]
    return links, scanner.base, ends[-1] if ends else None


def nested(k: int, link: tuple, css: bytes | None) -> list[tuple]:
    """The single references of the k-th link: those in a style or a srcset, else itself.  css: a style block's bytes."""
    offset, length, value, role, _, _, hint = link
    if role in ("style_block", "inline_style"):
        found = css_links(css if role == "style_block" else value.encode())
        return [(k, offset, length, role, "css" if imported else "other", n, at, size, ref, "") for n, (at, size, ref, imported) in enumerate(found)]
    if role == "srcset":
        return [(k, offset, length, role, hint, n, 0, 0, url, descriptor) for n, (url, descriptor) in enumerate(srcset_text(value))]
    return [(k, offset, length, role, hint, 0, 0, 0, value, "")]


def references(html: bytes) -> tuple[str | None, list[tuple]]:
    """The base's href and every single reference: nested ones of styles and srcsets too."""
    scanner = HtmlScanner()
    links = scanner.feed(html, last=True)
    return scanner.base, [r for k, x in enumerate(links) for r in nested(k, x, scanner.blocks.get(x[0]))]


def robots(text: str, agent: str) -> tuple[list[tuple[str, bool]], list[str], int]:
    """Rules for an agent, sitemaps and the delay.

    Agent lines in a row head one group; any other directive ends the row.  Groups that name the agent, or a beginning of
    it, hold if there are any, else the groups for *.
    """
    token = agent.lower()
    groups: list[tuple[set[str], list[tuple[str, str]]]] = []
    sitemaps, heading = [], False
    for line in text.split("\n"):
        field, colon, value = line.split("#")[0].strip(SPACE).partition(":")
        field, value = field.strip(SPACE).lower(), value.strip(SPACE)
        if not colon:
            continue
        if field == "user-agent":
            if not heading:
                groups.append((set(), []))
            name = value.lower()
            groups[-1][0].add("any" if name == "*" else "own" if token and token.startswith(name) else "")
        elif field == "sitemap":
            sitemaps += [value] if value else []
        elif groups:
            groups[-1][1].append((field, value))
        heading = field == "user-agent"
    side = "own" if any("own" in names for names, _ in groups) else "any"
    lines = [x for names, body in groups if side in names for x in body]
    rules = [(v, f == "allow") for f, v in lines if f in ("allow", "disallow") and v]
    delay = 0
    for f, v in lines:
        if f == "crawl-delay" and (n := re.match(r"\+?([0-9]+\.?[0-9]*|\.[0-9]+)", v)) and float(n[1]) > 0:
            delay = int(float(n[1]) * 1000)
    return rules, sitemaps, delay


def _bytes(x) -> bytes:
    return x if isinstance(x, bytes) else x.encode()


@F.pandas_udf(SCAN)
def scan_html(body: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """links, base_href and head_end of HTML bodies (binary, or text)."""
    for batch in body:
        rows = [([], None, None) if x is None else html_links(_bytes(x)) for x in batch]
        yield pd.DataFrame({"links": [[dict(zip(LINK.names, y)) for y in r[0]] for r in rows], "base_href": [r[1] for r in rows], "head_end": pd.array([r[2] for r in rows], dtype="Int32")})


@F.pandas_udf(T.ArrayType(CSS_LINK))
def scan_css(body: pd.Series) -> pd.Series:
    return body.map(lambda x: [] if x is None else [dict(zip(CSS_LINK.names, y)) for y in css_links(_bytes(x))])


@F.pandas_udf(REFS)
def scan_references(body: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """base_href and the references of HTML bodies, nested ones too."""
    for batch in body:
        rows = [(None, []) if x is None else references(_bytes(x)) for x in batch]
        yield pd.DataFrame({"base_href": [r[0] for r in rows], "refs": [[dict(zip(REF.names, y)) for y in r[1]] for r in rows]})


def parse_robots(agent: str):
    """A function from robots.txt texts to their rules for an agent."""

    @F.pandas_udf(ROBOTS)
    def of(text: pd.Series) -> pd.DataFrame:
        rows = [robots(x or "", agent) for x in text]
        return pd.DataFrame({"rules": [[dict(zip(RULE.names, y)) for y in r[0]] for r in rows], "sitemaps": [r[1] for r in rows], "crawl_delay_ms": [r[2] for r in rows]})

    return of
