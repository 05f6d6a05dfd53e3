import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as T

CASES = [
    (T.join_soft_hyphens, "charac­ ter", "character"),
    (T.drop_soft_hyphens, "charac­ ter", "charac ter"),
    (T.strip_footnote_number, "Hello world.123", "Hello world."),
    (T.strip_footnote_number, "see pp. 12", "see pp."),
    (T.strip_footnote_number, "about 3.14", "about 3."),
    (T.strip_footnote_number, "12 monkeys ran", "12 monkeys ran"),
    (T.spell_ligatures, "ﬁrst ﬂy oﬀ ﬃ ﬄ ﬅ", "first fly off ffi ffl st"),
    (T.fix_misread, "todayÕs 1988Ð1998 ÒxÓ Ñ", "today's 1988–1998 \"x\" —"),
    (T.space_punctuation, "Hi . 'ok' , a .NET ? b !", "Hi.'ok', a NET? b!"),
    (T.space_brackets, "( a ) [ b ] { c }", "(a) [b] {c}"),
    (T.close_apostrophes, "dog ' s bone, cat 's", "dog's bone, cat's"),
    (T.straight_quotes, "“a” ‘b’", "\"a\" 'b'"),
    (T.one_space, "  a\n\tb  c\x1cd ", "a b c d"),
    (T.plain_dashes, "a—b–c", "a-b-c"),
    (T.title_case, "WELL-KNOWN O'NEIL 3RD", "Well-Known O'Neil 3Rd"),
    (T.enhance_title, " IV THE BEGINNING ", "IV The Beginning"),
    (T.enhance_title, "JOHN'S BOOK", "John's Book"),
    (T.enhance_title, "XIV", "XIV"),
    (T.enhance_title, "Not Capitals", "Not Capitals"),
    (T.normal_token, "Eötvös.", "eotvos"),
    (T.normal_token, "well-known", "wellknown"),
    (T.normal_token, "ﬁne Ａｂｃ ½ Ⓐ", "fine abc 12 a"),
    (T.title_case, "漢字ABC ǆ", "漢字Abc ǅ"),
    (T.enhance_title, "ǅUP", "ǅUP"),
    (T.space_brackets, "x ) . ( ( a", "x) . ((a"),
    (T.clean, "x , . ) ( , )  y", "x,.) (,) y"),
    (T.coerce_class, "FOOTNOTE", "footnote"),
    (T.coerce_class, "BODY TEXT", "body"),
    (T.coerce_class, "INDEX", "drop"),
    (T.coerce_class, "table of contents", "body"),
    (T.coerce_class, "zzz", None),
    (T.normal_line, "Ab-C 1!", "abc1"),
]


def test_functions(spark):
    df = spark.createDataFrame([(k, a) for k, (_, a, _) in enumerate(CASES)], "k int, x string")
    columns = [F.max(F.when(F.col("k") == k, f(F.col("x")))).alias(f"c{k}") for k, (f, _, _) in enumerate(CASES)]
    got = df.agg(*columns).first()
    for k, (f, given, wanted) in enumerate(CASES):
        assert got[k] == wanted, (f.__name__, given)


@pytest.mark.parametrize(("given", "ends", "punctuated"), [("", False, False), ("a.", True, True), ('a."', True, False), (".", True, True), ('"', False, False), ("a.\n", False, False), ("(b!)", True, False), ("a)", False, False), (None, False, False)])
def test_sentence_end(spark, given, ends, punctuated):
    df = spark.createDataFrame([(given,)], "x string")
    assert df.select(T.is_sentence_end(F.col("x")), T.ends_with_punctuation(F.col("x"))).first() == (ends, punctuated)


def test_roman(spark):
    df = spark.createDataFrame([(x,) for x in ("I", " iv ", "MMMCMXCIX", "", "IIII", "ABC")], "x string")
    assert [r[0] for r in df.select(T.is_roman(F.col("x"))).collect()] == [True, True, True, True, False, False]


def test_join_pieces(spark):
    df = spark.createDataFrame([(["First sentence.", "Second"],), (["First", " second "],), ([],), ([" ", "a.", "", "b"],)], "p array<string>")
    assert [r[0] for r in df.select(T.join_pieces(F.col("p"))).collect()] == ["First sentence.\nSecond", "First second", "", "a.\nb"]


def test_list_prefix_and_size(spark):
    df = spark.createDataFrame([("(3) abc", "abc"), ("3. abc", "4. abc"), ("abc", "abc")], "o string, c string")
    assert [r[0] for r in df.select(T.restore_list_prefix(F.col("o"), F.col("c"))).collect()] == ["(3) abc", "4. abc", "abc"]
    df = spark.createDataFrame([("a" * 100, "a" * 90), ("a" * 100, "a" * 89), ("", "abc"), ("ab­\n" * 10, "ab" * 10)], "o string, c string")
    assert [r[0] for r in df.select(T.size_differs(F.col("o"), F.col("c"))).collect()] == [False, True, False, False]


def test_white_space_takes_linear_time(spark):
    """A million spaces take no more than some times as long as a quarter of them, ended by what the patterns look for."""
    import time

    def took(n):
        blank = " " * n
        df = spark.createDataFrame([(f"a{blank}{end}{blank}b",) for end in ("x", ",", "'s", ")", "12")], "x string")
        began = time.time()
        got = [r[0] for r in df.select(T.clean(T.join_soft_hyphens(F.col("x")), True)).collect()]
        assert got == ["a x b", "a, b", "a's b", "a) b", "a 12 b"]
        return time.time() - began

    took(1000)
    short, long = min(took(250_000) for _ in range(2)), took(1_000_000)
    assert long < 10 * short + 1
    assert long < 20


def test_title_keeps_its_own_leading_numeral(spark):
    """Words that are Roman numerals by the pattern stay as they are, put in or not."""
    df = spark.createDataFrame([("CI OSES CIÓN X'S",), ("MI MI OS X'S",), ("CIO OSES X'S",)], "x string")
    assert [r[0] for r in df.select(T.enhance_title(F.col("x"))).collect()] == ["CI Oses Ción X's", "MI Mi Os X's", "Cio Oses X's"]
