"""Comparing two versions of a document line by line, with tolerance for spelling variants. Columns only.

Lines are aligned by number. Lines that are equal but for case and punctuation do not differ. Of the others those stay that
have a word without a variant at its place in the other line. Two spellings of a word are variants if the letters that one
has beyond the other are a fifth of all letters of both at most: the edit distance counts a changed letter once, which is
one letter too many on each side, so of d edits and a difference in length of k the letters beyond are 2 d - k. Two swapped
letters are two edits but only one letter on each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as T

#: The letters of both words for each that is beyond the other.
SHARE = 5


def are_variants(p: Column, q: Column) -> Column:
    """Two words in lower-case letters."""
    both, apart = F.length(p) + F.length(q), F.abs(F.length(p) - F.length(q))
    edits = F.levenshtein(p, q)
    same_letters = F.array_sort(F.split(p, "")) == F.array_sort(F.split(q, ""))
    beyond = F.when((edits == 2) & same_letters, F.lit(2)).otherwise(F.lit(2) * edits - apart)
    return (p == q) | (F.lit(SHARE) * beyond <= both)


def only_variants(a: Column, b: Column) -> Column:
    """The lines have as many words, and each is a variant of the one at its place."""
    words = lambda line: F.split(T.stripped(F.lower(line)), f"{T.SPACE}++")
    letters = lambda word: F.regexp_replace(word, "[^a-z]", "")
    pairs = F.arrays_zip(words(a).alias("p"), words(b).alias("q"))
    return (F.size(words(a)) == F.size(words(b))) & F.forall(pairs, lambda w: are_variants(letters(w["p"]), letters(w["q"])))


def differing_lines(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, a, b) that one side lacks or that differ by more than letters' case, punctuation and
    spelling variants."""
    key = ["doc_id", "line_no"]
    both = left.select(*key, F.col("line").alias("a")).join(right.select(*key, F.col("line").alias("b")), key, "full_outer")
    differ = both.filter(F.coalesce(T.normal_line(F.col("a")) != T.normal_line(F.col("b")), F.lit(True)))
    return differ.filter(~F.coalesce(only_variants(F.col("a"), F.col("b")), F.lit(False)))
