"""Words of texts, whatever their case, punctuation, markup and layout."""

from __future__ import annotations

import html
import re
import unicodedata

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|[nrt])")
#: What may stand before the text of a line: quote marks, comment signs, list signs, a number, a time, a speaker.
_PREFIX = re.compile(r"^[ \t]*(?:(?:[>|#*+/;%$=~-]+|\[?\d{1,6}[\].):]|\[?\d\d:\d\d(?::\d\d)?\]?|[a-z][\w-]{0,24}:)[ \t]+)+", re.M | re.I)
_HYPHEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """The text in lower case without invisible characters, tags, escapes of JSON strings and line prefixes."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    return _PREFIX.sub("", text).lower()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits; none of null and empty texts."""
    return _WORD.findall(plain(text)) if text else []
