"""Quality rules: a threshold table compiled into one Spark projection.

Words are the runs of characters outside 0x20 and 0x09-0x0D. The metrics of a text are array expressions over its words
and lines; THRESHOLDS is turned into columns, so the whole verdict is a projection of the scan: no exchange, no Python.

Defined results: a null text has no words and fails; ties, repeated rows and extra columns change nothing, each row is
judged alone; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import pick

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Frequent function words of the languages served, lower case; those that the SQL below lists.
STOP_WORDS = ("a an and are as at be by for from he in is it of on or that the this to was were with "
              "à au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
              "al como con del el los las lo no para por se su y "
              "als auf aus bei das dem den der die ein eine einen für im ist mit nicht sich sie und von zu").split()  # fmt: skip
#: (metric, comparison, threshold): a text that meets any of them is rejected. The base is a table of its own, over whole
#: numbers, so that no rounding decides.
BASE = (
    ("words", "<", 10),
    ("repeat_excess", ">", 0),
)
THRESHOLDS = (
    ("mean_word_length", "<", 1.5),
    ("mean_word_length", ">", 16.0),
    ("symbol_word_ratio", ">", 0.25),
    ("stop_word_ratio", "<", 0.02),
    ("dup_line_ratio", ">", 0.50),
)
# Fixed value: per cent of the words that may stand in repeated windows.
REPEAT_PERCENT = 20


def _over(x: Column, y: Column) -> Column:
    return F.when(y > 0, x.cast("double") / y.cast("double")).otherwise(F.lit(0.0))


def compiled(rules=THRESHOLDS) -> Column:
    """True where no rule of the table is met; a table without rules keeps all."""
    test = {"<": lambda a, b: a < b, ">": lambda a, b: a > b}
    return ~reduce(lambda a, b: a | b, (test[how](F.col(metric), F.lit(limit)) for metric, how, limit in rules), F.lit(False))


def metrics(docs: DataFrame) -> DataFrame:
    """One row per text: doc_id, the counts and the ratios that the threshold table names."""
    df = pick(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    df = df.select("doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    df = df.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE + "+", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: F.rtrim(F.lower(x), F.lit(",.")).isin(STOP_WORDS))).cast("bigint").alias("n_stop"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    grams = F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(WINDOW))))
    df = df.withColumn("g", F.when(F.size("h") >= WINDOW, grams).otherwise(F.array().cast("array<bigint>"))).drop("h")
    # only a text with a repeated window is sorted
    ranked = F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    df = df.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), ranked)).drop("g")
    twice = F.filter("s", lambda x, k: F.coalesce(F.get("s", k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("s", k + 1)["g"] == x["g"], F.lit(False)))
    df = df.withColumn("p", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("s")
    covered = F.aggregate("p", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("p")
    c = F.col
    return df.select(
        "*",
        c("n_words").alias("words"),
        (F.lit(100) * c("n_repeat_words") - F.lit(REPEAT_PERCENT) * c("n_words")).alias("repeat_excess"),
        _over(c("n_repeat_words"), c("n_words")).alias("repeat_word_ratio"),
        _over(c("word_chars"), c("n_words")).alias("mean_word_length"),
        _over(c("n_symbols"), c("n_words")).alias("symbol_word_ratio"),
        _over(c("n_stop"), c("n_words")).alias("stop_word_ratio"),
        _over(c("n_dup_lines"), c("n_lines")).alias("dup_line_ratio"),
    )


def quality_rules(docs: DataFrame, rules=THRESHOLDS, base=BASE) -> DataFrame:
    """Counts of each text, base_failed, and kept: the verdict of both tables, every rule of them."""
    return metrics(docs).withColumn("base_failed", ~compiled(base)).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def query(spark, sf_dir):
    from quirefold.llm.common import table

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop")


# The SQL states words, ratios and limits for itself, so that a wrong constant above shows.
_STOP_SQL = "'a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'he', 'in', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'was', 'were', 'with', 'à', 'au', 'aux', 'avec', 'ce', 'dans', 'de', 'des', 'du', 'elle', 'en', 'est', 'et', 'il', 'la', 'le', 'les', 'ne', 'par', 'pas', 'pour', 'que', 'qui', 'se', 'sur', 'un', 'une', 'al', 'como', 'con', 'del', 'el', 'los', 'las', 'lo', 'no', 'para', 'por', 'su', 'y', 'als', 'auf', 'aus', 'bei', 'das', 'dem', 'den', 'der', 'die', 'ein', 'eine', 'einen', 'für', 'im', 'ist', 'mit', 'nicht', 'sich', 'sie', 'und', 'von', 'zu'"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        len(list_filter(w, lambda x: rtrim(lower(x), ',.') IN ({_STOP_SQL})))::BIGINT AS n_stop FROM w),
g AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' '))) AS g
        FROM w WHERE len(w) >= 5),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
p AS (SELECT doc_id, least(5, i - lag(i, 1, i - 5) OVER (PARTITION BY doc_id ORDER BY i)) AS adds FROM t WHERE n > 1),
r AS (SELECT doc_id, sum(adds) AS n FROM p GROUP BY doc_id),
a AS (SELECT c.*, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars / n_words::DOUBLE < 1.5 OR word_chars / n_words::DOUBLE > 16.0 OR n_symbols / n_words::DOUBLE > 0.25
    OR n_stop / n_words::DOUBLE < 0.02 OR (n_lines > 0 AND n_dup_lines / n_lines::DOUBLE > 0.5)) AS kept, n_lines, n_stop FROM b
"""
