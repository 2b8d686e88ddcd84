"""Words as byte strings, for the operators that score whole texts in numpy."""

from __future__ import annotations

import re

_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


#: Blocks of signs beyond ASCII that part words: Latin-1 signs, general punctuation, CJK punctuation, full-width punctuation.
_SIGNS = re.compile("[\u00a0-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u200b\u200e-\u206f\u3000-\u3003\u3008-\u3020\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text in UTF-8: runs of ASCII letters and of non-ASCII characters other than signs."""
    text = text or ""
    if not text.isascii():
        text = _SIGNS.sub(" ", text)
    return text.lower().encode("utf-8", "replace").translate(_KEEP).split()


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))
