"""English analysis: stop words and the published Porter2 (Snowball English) stemmer.

The stemmer is a small helper applied once per distinct word of a vocabulary.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# The Snowball English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now
""".split()

# Words the algorithm treats apart, and its suffix tables.
_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
_UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_DONE_AFTER_PLURAL = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
}
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
_STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
)

_VOWEL = "[aeiouy]"
_OTHER = "[^aeiouy]"
_REGION = re.compile(f"{_VOWEL}{_OTHER}")
_SHORT_END = re.compile(f"(?:{_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$")
_DOUBLE = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 start."""
    prefix = re.match("gener|commun|arsen", word)
    found = prefix or _REGION.search(word)
    r1 = found.end() if found else len(word)
    again = _REGION.search(word, r1)
    return r1, again.end() if again else len(word)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")):
        return word
    if word.endswith("s") and re.search(_VOWEL, word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix is None:
        return word
    rest = word[: -len(suffix)]
    if suffix.startswith("eed"):
        return rest + "ee" if len(rest) >= r1 else word
    if not re.search(_VOWEL, rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _DOUBLE.search(rest):
        return rest[:-1]
    return rest + "e" if len(rest) <= r1 and _SHORT_END.search(rest) else rest


def stem_word(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if word in _UNCHANGED:
        return word
    word = re.sub("(?<=[aeiouy])y|^y", "Y", word)
    r1, r2 = _regions(word)
    word = _plural(word)
    if word in _DONE_AFTER_PLURAL:
        return word
    word = _past(word, r1)
    word = re.sub(f"(?<=.{_OTHER})[yY]$", "i", word)

    suffix = _longest(word, _STEP2)
    if suffix and len(word) - len(suffix) >= r1:
        rest = word[: -len(suffix)]
        allowed = {"ogi": "l", "li": "cdeghkmnrt"}.get(suffix)
        if allowed is None or rest[-1:] in tuple(allowed):
            word = rest + _STEP2[suffix]
    suffix = _longest(word, _STEP3)
    if suffix and len(word) - len(suffix) >= (r2 if suffix == "ative" else r1):
        word = word[: -len(suffix)] + _STEP3[suffix]
    suffix = _longest(word, _STEP4)
    if suffix and len(word) - len(suffix) >= r2:
        rest = word[: -len(suffix)]
        if suffix != "ion" or rest.endswith(("s", "t")):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if len(rest) >= r2 or (len(rest) >= r1 and not _SHORT_END.search(rest)):
            word = rest
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map(stem_word)
