"""Text functions as Spark columns. Each is one expression; a chain of them is one projection inside code generation.

Patterns name their characters and take runs of white space possessively from their first character, so a pass is linear
in the text whatever stands in it. Lengths are code points.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters and patterns that results depend on.
SOFT_HYPHEN = "­"
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"))
MISREAD = (("Ò", '"'), ("Ó", '"'), ("Õ", "'"), ("Ñ", "—"), ("Ð", "–"))
CURLY_QUOTES = (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"))
DASHES = (("—", "-"), ("–", "-"))
#: White space but for the space; with the space, what str.isspace knows.
OTHER_SPACE = r"\t-\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE = rf"[\x20{OTHER_SPACE}]"
#: A whole run of white space. The first test, one range, rules out nearly every character at once.
RUN = f"[^!-~](?<={SPACE})(?<!{SPACE}{SPACE}){SPACE}*+"
WORD = r"[\p{L}\p{N}_]"
QUOTE_AFTER_END = r"""([.!?]) (['"])"""
DOT_BEFORE_LETTER = rf"\.(?<={SPACE}\.)([a-zA-Z])"
APOSTROPHES = ((rf"'{SPACE}++s({SPACE}|[.,!?;:])", "'s$1"), (rf"{RUN}'s({SPACE}|\z)", "'s$1"))
FOOTNOTE_NUMBER = rf"([.!?])(?<={WORD}[.!?]){SPACE}*+\p{{Nd}}++{SPACE}*+\z"
STRIP = rf"^{SPACE}++|{RUN}\z"
ROMAN = r"(?i)^(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
SENTENCE_END = r"""[.?!][)}\]"'”’]?\z"""
LIST_PREFIX = r"^(\(\p{Nd}+\)|\p{Nd}+[.)]) "
CLASS_HINTS = (
    ("footnote", "footnote|endnote|note"),
    ("body", "body|main|prose|content|paragraph|text"),
    ("drop", "index|bibliograph|reference|encyclop|glossar|appendix|contents|header|footer|caption|table"),
)
#: Characters that count as digits at the start of a note, beyond the decimal digits.
OTHER_DIGITS = "¹²³⁰⁴-⁹₀-₉①-⑨"


def _each(c: Column, pairs) -> Column:
    """Strings replaced one after the other; where none occurs a pass only scans bytes."""
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), pairs, c)


def _close_up(c: Column, before: str) -> Column:
    """White space before these characters goes."""
    return F.regexp_replace(c, f"{RUN}([{before}])", "$1")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def join_soft_hyphens(c: Column) -> Column:
    """Soft hyphens go, each with one white-space character after it."""
    return F.regexp_replace(c, f"{SOFT_HYPHEN}{SPACE}?", "")


def drop_soft_hyphens(c: Column) -> Column:
    return F.replace(c, F.lit(SOFT_HYPHEN), F.lit(""))


def strip_footnote_number(c: Column) -> Column:
    """A number after the last sentence end goes."""
    return F.regexp_replace(c, FOOTNOTE_NUMBER, "$1")


def spell_ligatures(c: Column) -> Column:
    return _each(c, LIGATURES)


def fix_misread(c: Column) -> Column:
    """Capitals that stand for quotes and dashes in wrongly decoded text."""
    return _each(c, MISREAD)


def _quotes_and_dots(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, QUOTE_AFTER_END, "$1$2"), DOT_BEFORE_LETTER, "$1")


def _open_brackets(c: Column) -> Column:
    return F.regexp_replace(c, rf"([(\[{{]){SPACE}++", "$1")


def space_punctuation(c: Column) -> Column:
    return _close_up(_quotes_and_dots(c), ",.?!")


def space_brackets(c: Column) -> Column:
    return _open_brackets(_close_up(c, r")\]}"))


def close_apostrophes(c: Column) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, rule[0], rule[1]), APOSTROPHES, c)


def straight_quotes(c: Column) -> Column:
    return _each(c, CURLY_QUOTES)


def plain_dashes(c: Column) -> Column:
    return _each(c, DASHES)


def one_space(c: Column) -> Column:
    """Runs of white space become one space; single spaces are left alone."""
    return F.trim(F.regexp_replace(c, rf"[^!-~](?:(?<=\x20){SPACE}++|(?<=[{OTHER_SPACE}]){SPACE}*+)", " "))


def clean_before_hyphens(c: Column, remove_footnotes: bool = False) -> Column:
    c = strip_footnote_number(c) if remove_footnotes else c
    # punctuation and closing brackets in one pass
    return close_apostrophes(_open_brackets(_close_up(_quotes_and_dots(fix_misread(spell_ligatures(c))), r",.?!)\]}")))


def clean_after_hyphens(c: Column) -> Column:
    return one_space(straight_quotes(c))


def clean(c: Column, remove_footnotes: bool = False) -> Column:
    """The whole chain but for hyphens that stand for dashes, which need a word list (functions.words.open_dashes)."""
    return clean_after_hyphens(clean_before_hyphens(c, remove_footnotes))


def ends_with_punctuation(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[.?!]\z"), F.lit(False))


def is_sentence_end(c: Column) -> Column:
    """The last character ends a sentence, or closes a bracket or quote right after one that does."""
    return F.coalesce(c.rlike(SENTENCE_END), F.lit(False))


def is_roman(c: Column) -> Column:
    """Roman numerals up to 3999 in any case; the empty string is one."""
    return stripped(c).rlike(ROMAN)


# Letters that have case; others, such as ideographs, end a word.
CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"


def title_case(c: Column) -> Column:
    """A capital after each character without case; initcap alone only looks at spaces."""
    runs = F.regexp_extract_all(c, F.lit(f"[{CASED}]++|[^{CASED}]++"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.initcap(F.lower(x))), "")


def is_upper(c: Column) -> Column:
    return c.rlike(r"\p{IsUppercase}") & ~c.rlike(r"[\p{IsLowercase}\p{Lt}]")


def enhance_title(c: Column) -> Column:
    """Titles in capitals become title case, but for a leading Roman numeral."""
    t = stripped(c)
    first = F.substring_index(t, " ", 1)
    keeps = is_roman(first) & (first != t)
    cased = F.when(keeps, F.concat(first, title_case(F.substring(t, F.length(first) + 1, F.length(t))))).otherwise(title_case(t))
    cased = F.replace(F.replace(cased, F.lit("'S"), F.lit("'s")), F.lit("’S"), F.lit("’s"))
    return F.when(is_upper(t) & ~is_roman(t), cased).otherwise(t)


def join_pieces(pieces: Column) -> Column:
    """An array of pieces as one paragraph: a line break after a piece that ends a sentence, else a space."""
    solid = F.filter(F.transform(pieces, stripped), lambda x: x != "")
    text = F.array_join(F.transform(solid, lambda x: F.concat(x, F.when(is_sentence_end(x), F.lit("\n")).otherwise(F.lit(" ")))), "")
    return F.substring(text, F.lit(1), F.length(text) - 1)


def coerce_class(c: Column) -> Column:
    """The nearest of footnote, body and drop that a label hints at, in that order; null if none."""
    low = F.lower(c)
    return F.coalesce(*(F.when(low.rlike(hints), F.lit(name)) for name, hints in CLASS_HINTS))


def restore_list_prefix(original: Column, cleaned: Column) -> Column:
    """A list number that the original begins with and the cleaned text lost comes back."""
    prefix = F.regexp_extract(original, LIST_PREFIX, 0)
    return F.when((prefix != "") & ~cleaned.rlike(LIST_PREFIX), F.concat(prefix, cleaned)).otherwise(cleaned)


def printable_length(c: Column) -> Column:
    """Characters that are neither separators other than the space nor of class C."""
    return F.length(F.regexp_replace(c, r"[\p{C}\p{Z}&&[^ ]]", ""))


def size_differs(original: Column, cleaned: Column, limit: float = 0.10) -> Column:
    n = printable_length(original)
    return (n > 0) & (F.abs(F.length(cleaned) - n) / n > F.lit(limit))


@F.arrow_udf(StringType())
def fold_diacritics(column: pa.Array) -> pa.Array:
    """Compatibility decomposition, then what is left of ASCII. No table of single letters can say this: one character may
    become several."""
    import unicodedata

    return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in column.to_pylist()], pa.string())


def normal_token(c: Column) -> Column:
    """A token without punctuation, dashes, diacritics and case, for loose comparison."""
    return F.lower(fold_diacritics(F.regexp_replace(c, r"""[.,;:!?"'()\[\]—–-]""", "")))


def normal_line(c: Column) -> Column:
    """Letters and digits of ASCII, lower case, for comparing lines of two documents."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def speech_segments(c: Column) -> Column:
    """What a synthesiser is given one by one: the text split at line breaks, without blanks."""
    return F.filter(F.split(c, r"\n+"), lambda x: F.trim(x) != "")
