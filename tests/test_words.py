import pytest
from pyspark.sql import functions as F

from quirefold.functions import words

RULES = words.Validator("dog goose test possible happy create quick character self evident well known demarcation criticism judicial judiciary and the include".split(), senses="known character self evident goose".split(), bases={"geese": "goose"})


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("electrical", "electr"), ("adjustable", "adjust"), ("probate", "probat"), ("controll", "control"), ("is", "is")])
def test_stem(word, stem):
    assert words.porter_stem(word) == stem


def test_valid():
    assert [RULES.is_valid(w) for w in ("dog", "Dog", "geese", "testability", "possibility", "happiness", "quickly", "tests", "xqzjkl", "")] == [True] * 8 + [False] * 2


def test_base_forms():
    plain = words.Validator("goose mouse city wolf knife church box man dog glass".split())
    assert all(plain.is_valid(w) for w in ("geese", "mice", "cities", "wolves", "knives", "churches", "boxes", "men", "dogs", "glasses"))
    assert not any(plain.is_valid(w) for w in ("s", "gees", "xies"))


def test_all_valid():
    assert RULES.all_valid("The dog, tested!")
    assert RULES.all_valid("")
    assert not RULES.all_valid("self-evident")
    assert not RULES.all_valid("dog — test")


def test_dashes():
    assert RULES.open_dashes("demarcation-the well-known a-b-the") == "demarcation - the well-known a - b-the"


def test_join():
    assert RULES.join_hyphens("charac- ter self-evident charac-ter foo-bar") == "character self-evident character foo-bar"
    assert RULES.join_hyphens("Zur­ ich") == "Zurich"
    assert RULES.join_hyphens("nothing here") == "nothing here"


@pytest.mark.parametrize(("old", "new", "wanted"), [
    ("the judiciary ruled", "the judicial ruled", "the judiciary ruled"),
    ("a xqz b", "a quick b", "a quick b"),
    ("in 1 959. end", "in 1959. end", "in 1959. end"),
    ("x - including y", "x —including y", "x - including y"),
    ("i. e., so", "i.e., so", "i.e., so"),
    ("well known", "well-known", "well-known"),
    ("false—as", "false-as", "false—as"),
    ("false-as", "false—as", "false—as"),
    ("one two", "one two three", "one two three"),
    ("the Criti cism ruled", "the Criticism ruled", "the Criticism ruled"),
    ("a Ph. D in", "a Ph.D. in", "a Ph.D. in"),
    ("a criticism - and its", "a criticism—and its", "a criticism—and its"),
    ("a criticism - the", "a criticism - the", "a criticism - the"),
    ("of demarcation-the x", "of demarcation - the x", "of demarcation - the x"),
    ("said 'Dog is", "said ‘Dog is", "said ‘Dog is"),
    ("the dog'.", "the dog’.", "the dog’."),
    ("The quick dog", "The happy test", "The quick dog"),
    ("Popper (1 977), x", "Popper (1977), x", "Popper (1977), x"),
])
def test_restore(old, new, wanted):
    assert RULES.restore_words(old, new) == wanted


def test_in_spark(spark):
    df = spark.createDataFrame([(1, "The dog"), (2, "xqz dog demarcation-the"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r.text for r in words.open_dashes(df, "text", RULES).collect()}
    assert got == {1: "The dog", 2: "xqz dog demarcation - the", 3: None, 4: ""}
    lexicon = spark.createDataFrame([("the",), ("dog",)], "word string")
    full = {r.id: (r.n_invalid, r.all_valid) for r in words.gate(df, ["id"], "text", None, RULES).collect()}
    plain = {r.id: (r.n_invalid, r.all_valid) for r in words.gate(df, ["id"], "text", lexicon).collect()}
    assert full == {1: (0, True), 2: (2, False), 3: (0, True), 4: (0, True)}
    assert plain == full
    words_at_most, words.LEXICON_WORDS = words.LEXICON_WORDS, 1  # a lexicon too large to send is joined
    try:
        assert {r.id: (r.n_invalid, r.all_valid) for r in words.gate(df, ["id"], "text", lexicon).collect()} == full
    finally:
        words.LEXICON_WORDS = words_at_most
    assert words.validator(words.lexicon_from_text(df, "text")).is_valid("dog")
    assert df.select(words.restore_words(spark, RULES)("text", F.lit("a"))).count() == 4
