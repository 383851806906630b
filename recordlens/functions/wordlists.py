"""The words of a text cut in Python, for texts whose characters are the same to every version of Unicode.

``text.lexemes`` and ``text.query_lexeme_array`` say what a word is; here the same words are
cut from texts of Latin letters and general punctuation, several times as fast.  Other texts are left
to those.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column

from .text import IGNORED_WORDS, MIN_TERM_LENGTH, WHITESPACE

# Latin letters, marks and general punctuation.
_PLAIN = (range(0x370), range(0x2000, 0x2070))
_OTHER = r"[^\x{0}-\x{36f}\x{2000}-\x{206f}]"
# White space becomes a blank, all else that is no letter or digit goes.
_CUT = {c: " " if chr(c) in WHITESPACE else None for part in _PLAIN for c in part
        if chr(c) in WHITESPACE or not (unicodedata.category(chr(c)).startswith("L") or unicodedata.category(chr(c)) == "Nd")}
# ``split`` sees the same white space as ``text.WHITESPACE``, once the rest is gone.
_GONE = re.compile("[" + "".join(re.escape(chr(c)) for c, to in _CUT.items() if to is None) + "]+")
_IGNORED = frozenset(IGNORED_WORDS)


def is_plain(col: Column) -> Column:
    """Whether the functions below cut this text."""
    return ~col.rlike(_OTHER)


def _words(text: str) -> list[str]:
    return (text.translate(_CUT) if text.isascii() else _GONE.sub("", text)).split()


def plain_lexemes(text: str) -> list[str]:
    """What ``lexemes`` gives: lower-case words in order, repeats kept."""
    return _words(text.lower())


def plain_query_lexemes(text: str, max_terms: int | None = None) -> list[str]:
    """What ``query_lexeme_array`` gives: distinct usable words in lower case, in order."""
    if text.isascii():
        words = [w for w in dict.fromkeys(plain_lexemes(text)) if len(w) >= MIN_TERM_LENGTH and w not in _IGNORED]
    else:
        # A letter may be longer in lower case: a word's length is that of its own spelling.
        usable = [w for w in _words(text) if len(w) >= MIN_TERM_LENGTH]
        words = [w for w in dict.fromkeys(w.lower() for w in usable) if w not in _IGNORED]
    return words if max_terms is None else words[:max_terms]
