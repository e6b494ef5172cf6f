"""Streaming parser events of HTML pages, read into blocks of visible text.

Pages go through a parser of the standard library that calls back for each tag and text. Well-formed
pages (once void elements are closed and entities decoded) take the faster one of its two streaming
parsers, all others the lenient one; both feed the same collector, so a page gives the same blocks.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from xml.parsers import expat

#: Tags that don't end a block.
INLINE = frozenset({"a", "abbr", "b", "em", "i", "small", "span", "strong", "u"})
#: Elements whose text is not visible body text.
HIDDEN = frozenset({"head", "script", "style", "noscript", "template"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})

_VOID_TAG = re.compile(r"<(area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr)\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)/?>", re.I)
_CLOSED_BREAK = re.compile(r"<br>|<hr>")
_PROLOG = re.compile(r"\s*(?:<!doctype[^>\[]*>)?\s*", re.I)
_ENTITY = re.compile(r"&(#?\w+;)?")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_RAW = re.compile(r"(<(script|style)\b[^<>]*>).*?</\2\s*>", re.S | re.I)
_BARE = frozenset({"lt;", "gt;", "amp;", "quot;", "apos;"})


class Page:
    """Elements and blocks of a page in document order.

    ``tags``, ``parents`` and ``names`` (class, id and role) describe the elements that are not inline;
    ``texts``, ``owners``, ``links`` and ``weights`` the blocks: text, innermost element, characters
    inside links, and the number of tags since the block before (the denominator of a text-to-tag
    ratio). ``title`` is null if there is none; ``hidden_notices`` is the text of ``noscript``; ``own``
    keeps the positions of the own body's blocks once they are known."""

    __slots__ = ("tags", "parents", "names", "texts", "owners", "links", "weights", "title", "hidden_notices", "own", "_stack", "_open", "_hidden", "_buffer", "_link", "_in_link", "_count", "_title", "_notice")

    def __init__(self) -> None:
        self.tags: list[str] = ["#page"]
        self.parents: list[int] = [-1]
        self.names: list[str] = [""]
        self.texts: list[str] = []
        self.owners: list[int] = []
        self.links: list[int] = []
        self.weights: list[int] = []
        self.title: str | None = None
        self.hidden_notices = ""
        self.own: list[int] | None = None
        self._stack = [0]
        self._open: list[str] = []
        self._hidden = 0
        self._buffer: list[str] = []
        self._link = 0
        self._in_link = 0
        self._count = 0
        self._title: list[str] | None = None
        self._notice = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._buffer).split())
        self._buffer.clear()
        if text:
            self.texts.append(text)
            self.owners.append(self._stack[-1])
            self.links.append(min(self._link, len(text)))
            self.weights.append(self._count)
            self._count = 0
        self._link = 0

    def start(self, tag: str, attrs: dict[str, str | None]) -> None:
        self._count += 1
        if tag in INLINE:
            if tag == "a":
                self._in_link += 1
            self._open.append(tag)
            return
        if self._buffer:
            self._flush()
        if tag in HIDDEN:
            self._hidden += 1
            if tag == "noscript":
                self._notice += 1
        elif tag == "title" and self.title is None and self._title is None:
            self._title = []
        if tag in VOID:
            return
        self._open.append(tag)
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.names.append(" ".join(v for k in ("class", "id", "role") if (v := attrs.get(k))) if attrs else "")
        self._stack.append(len(self.tags) - 1)

    def end(self, tag: str) -> None:
        if tag not in INLINE and self._buffer:
            self._flush()
        opened = self._open
        if not opened or tag in VOID:
            return
        if opened[-1] != tag:
            if tag not in opened:
                return
            while opened[-1] != tag:
                self._close(opened.pop())
        self._close(opened.pop())

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self._in_link -= 1
            return
        if self._buffer:
            self._flush()
        if tag in HIDDEN:
            self._hidden -= 1
            if tag == "noscript":
                self._notice -= 1
        elif tag == "title" and self._title is not None:
            self.title, self._title = " ".join("".join(self._title).split()), None
        self._stack.pop()

    def data(self, text: str) -> None:
        if self._title is not None:
            self._title.append(text)
        elif self._hidden:
            if self._notice:
                self.hidden_notices += text
        else:
            self._buffer.append(text)
            if self._in_link:
                self._link += len(text)

    def close(self) -> Page:
        if self._buffer:
            self._flush()
        if self._title is not None:
            self.title, self._title = " ".join("".join(self._title).split()), None
        self.hidden_notices = " ".join(self.hidden_notices.split())
        return self


class _Lenient(HTMLParser):
    def __init__(self, page: Page) -> None:
        super().__init__(convert_charrefs=True)
        self.page = page
        self.handle_data = page.data
        self.handle_endtag = page.end

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.page.start(tag, dict(attrs))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # As browsers do: a closing slash means nothing on elements that can have content.
        self.page.start(tag, dict(attrs))


def _decoded(m: re.Match) -> str:
    name = m[1]
    if name is None:
        return "&amp;"
    if name in _BARE:
        return m[0]
    text = html.unescape(m[0])
    return text if text != m[0] and text not in "<>&" else f"&amp;{name}"


def read_page(text: str) -> Page:
    """Blocks and elements of the page ``text``; an empty or contentless page has none."""
    if "/>" not in text and "<![" not in text:
        page = Page()
        try:
            source = _CLOSED_BREAK.sub(lambda m: m[0][:-1] + "/>", _COMMENT.sub("", text) if "<!--" in text else text)
            if "<script" in source or "<style" in source:
                source = _RAW.sub(r"\1</\2>", source)
            if "<meta" in source or "<input" in source or "<img" in source or "<link" in source:
                source = _VOID_TAG.sub(r"<\1\2/>", source)
            if "&" in source:
                source = _ENTITY.sub(_decoded, source)
            parser = expat.ParserCreate()
            parser.buffer_text = True
            parser.StartElementHandler = page.start
            parser.EndElementHandler = page.end
            parser.CharacterDataHandler = page.data
            # One root, so that fragments and text around elements parse too.
            parser.Parse("<x-page>", False)
            parser.Parse(source[_PROLOG.match(source).end() :], False)
            parser.Parse("</x-page>", True)
            if all(map(str.islower, page.tags)):
                return page.close()
        except (expat.ExpatError, UnicodeEncodeError):
            pass
    page = Page()
    parser = _Lenient(page)
    page.start("x-page", {})
    parser.feed(text)
    parser.close()
    return page.close()
