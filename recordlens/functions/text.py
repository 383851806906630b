"""Column expressions over text.  All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The characters of the Unicode White_Space property.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as ranges, which a regex engine tests faster than a list.
WS_RANGES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = "[" + WS_RANGES + "]"
NOT_LETTER_OR_DIGIT = r"[^\p{L}\p{Nd}]"

# Words that never become query terms.
IGNORED_WORDS = [
    "the", "and", "but", "for", "was", "were", "are", "you", "your", "this", "that", "with",
    "from", "have", "has", "had", "not", "can", "will", "would", "could", "should", "when",
    "what", "why", "how", "does", "did", "get", "got", "any", "all", "its", "it's", "there",
    "then", "than", "know", "known", "problem", "issue", "vehicle", "car", "truck", "mine",
]
MIN_TERM_LENGTH = 3
MAX_TERMS = 24
SNIPPET_LENGTH = 240
COMPONENT_PREFIX_LENGTH = 12
ELLIPSIS = "\u2026"


def trim_ws(col: Column) -> Column:
    """Trim every kind of white space, not only the blank."""
    return F.trim(col, F.lit(WHITESPACE))


def collapse_ws(col: Column) -> Column:
    """Collapse runs of white space to one blank and trim the ends."""
    return F.trim(F.regexp_replace(col, WS + "+", " "))


def is_blank(col: Column) -> Column:
    return F.coalesce(trim_ws(col) == "", F.lit(True))


def non_blank(col: Column) -> Column:
    """The trimmed text, or null when nothing is left."""
    return F.nullif(trim_ws(col), F.lit(""))


def raw_words(col: Column) -> Column:
    """White-space separated words reduced to letters and digits; the outer ones may be empty."""
    return F.split(F.regexp_replace(col, r"[^\p{L}\p{Nd}" + WS_RANGES + "]+", ""), WS + "+")


def words(col: Column) -> Column:
    """White-space separated words reduced to letters and digits; empty ones dropped."""
    return F.filter(raw_words(col), lambda w: w != "")


def lexemes(col: Column) -> Column:
    """The words of a text in lower case, in order, repeats kept."""
    return words(F.lower(col))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for an expression that reads it many times, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _usable_words(col: Column) -> Column:
    return F.filter(
        words(F.coalesce(col, F.lit(""))),
        lambda w: (F.length(w) >= MIN_TERM_LENGTH) & ~F.lower(w).isin(IGNORED_WORDS),
    )


def query_term_array(col: Column, max_terms: int | None = MAX_TERMS) -> Column:
    """Distinct usable terms of a question, first spelling kept, at most ``max_terms`` (None: all)."""
    return let(_usable_words(col), lambda spelled: let(
        F.transform(spelled, lambda w: F.lower(w)),
        lambda lowered: F.transform(
            F.slice(F.array_distinct(lowered), 1, max_terms or 2**31 - 1),
            lambda t: F.struct(
                F.get(spelled, F.array_position(lowered, t).cast("int") - 1).alias("term"),
                t.alias("lexeme"),
            ),
        ),
    ))


def query_lexeme_array(col: Column, max_terms: int | None = MAX_TERMS) -> Column:
    """The lexemes of ``query_term_array`` alone: a spelling is looked for in the whole text, word by word."""
    return F.slice(F.array_distinct(F.transform(_usable_words(col), lambda w: F.lower(w))), 1, max_terms or 2**31 - 1)


def snippet(col: Column, n: int = SNIPPET_LENGTH) -> Column:
    """The collapsed text, cut at the last blank at or before ``n`` with an ellipsis."""
    head = lambda text: F.substring(text, 1, n + 1)
    cut = lambda text: F.when(
        F.instr(head(text), " ") > 0, F.regexp_extract(head(text), "^(.*) ", 1)
    ).otherwise(F.substring(text, 1, n))
    return let(collapse_ws(col), lambda text: F.when(F.length(text) <= n, text).otherwise(
        F.concat(cut(text), F.lit(ELLIPSIS))
    ))


def single_line(col: Column) -> Column:
    """Trimmed text with each line ending replaced by a blank."""
    return F.regexp_replace(trim_ws(col), "\\r\\n|[\\n\\r\\f\\x85\\u2028\\u2029]", " ")


def component_prefix(col: Column, n: int = COMPONENT_PREFIX_LENGTH) -> Column:
    return F.substring(F.coalesce(trim_ws(col), F.lit("")), 1, n)


def cited_id(col: Column) -> Column:
    """Strip a leading ``RECORD `` label, in any case."""
    return trim_ws(F.regexp_replace(trim_ws(col), "(?i)^RECORD ", ""))


def escape_regex(col: Column) -> Column:
    return F.regexp_replace(col, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def quote_pattern(quote: Column) -> Column:
    """A regex that finds the quote verbatim, any run of white space matching any other."""
    gap = WS.replace("\\", "\\\\") + "+"
    return F.regexp_replace(escape_regex(collapse_ws(quote)), " ", gap)


def option(col: Column, names: list[str], default: str) -> Column:
    """A named option in any case, its default when blank, null when unknown."""
    given = F.lower(trim_ws(col))
    chosen = F.when(is_blank(col), F.lit(default))
    for name in names:
        chosen = chosen.when(given == name.lower(), F.lit(name))
    return chosen


def case_id(investigation: Column, complaint: Column) -> Column:
    return F.concat(investigation, F.lit(":"), complaint)


def result_key(mode: Column, pool: Column) -> Column:
    """``mode`` for the pool of all records, ``campaignsMode`` for a narrower one."""
    return F.when(pool == "all", mode).otherwise(F.concat(pool, F.initcap(mode)))
