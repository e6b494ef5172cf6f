"""Words of a text as they are compared across documents.

Words are runs of letters or digits. Letter case, punctuation, spacing, markup, character escapes and
accents make no difference (``ø`` = ``o``, ``å`` = ``a``, ``æ`` = ``ae``).
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache
from urllib.parse import unquote

_INLINE_TAG = re.compile(r"</?(?:a|abbr|b|em|i|small|span|strong|u)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|<![A-Za-z][^<>]*>", re.S)
_UNICODE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})")
_PERCENT_ESCAPE = re.compile(r"(?:%[89A-Fa-f][0-9A-Fa-f])+")
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=65536)
def _folded(char: str) -> str:
    """What a lower-case character beyond ASCII is compared as; format characters vanish."""
    if char in "øǿ":
        return "o"
    if char in "æǽ":
        return "ae"
    if unicodedata.category(char) == "Cf":
        return ""
    plain = unicodedata.normalize("NFKD", char)
    return "".join(c for c in plain.lower() if not unicodedata.combining(c)).replace("ø", "o").replace("æ", "ae")


def plain(text: str) -> str:
    """``text`` without markup, escapes, case and accents."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "\\u" in text:
        text = _UNICODE_ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    if "%" in text:
        text = _PERCENT_ESCAPE.sub(lambda m: unquote(m[0]), text)
    text = text.lower()
    if not text.isascii():
        for char in set(_BEYOND_ASCII.findall(text)):
            text = text.replace(char, _folded(char))
    return text


def words(text: str | None) -> list[str]:
    """Words of a text in order; null and empty texts have none."""
    return _WORD.findall(plain(text)) if text else []


def words_but_numbers(text: str | None) -> list[str]:
    """As ``words``, all-digit words left out."""
    return [w for w in _WORD.findall(plain(text)) if not w.isdigit()] if text else []
