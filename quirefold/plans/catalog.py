"""Queries over the driver's tables, one for each operator, with the SQL that they are held against.

The tables hold no books, so documents give lines and layout items, conversations give labelled chunks, and pages give
sections. Artefacts that the data lack are put into the texts by expressions that both engines share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions import words
from quirefold.operators import chunks as C
from quirefold.operators import cleaner as L
from quirefold.operators import compare, html_sections, layout, speech
from quirefold.operators import paragraphs as P
from quirefold.sources import readers, sinks

QUERIES: dict[str, Callable[..., DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name):
    return readers.parquet(spark, f"{sf_dir}/{name}.parquet")


# ---- expressions that both engines share ----

SPOILT = (
    "concat(replace(replace(replace(replace(replace(replace(text, '. ', ' . '), ', ', ' , '), 'fi', 'ﬁ'), ' the ', ' (  the ] '), ' de ', ' “de” Ñ '), ' of', ' ''s of'), ' dog '' s, [ x ] Õ !  ? .Net end. 12')"
)
SOFT = "replace(replace(text, 'en', 'e­ n'), 'er', 'e­r')"
LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS seq FROM documents)"""
CAPITALS = "upper(replace(text, 'ß', 'ss'))"
ITEM_COLUMNS = {
    "item_kind": "CASE WHEN seq % 13 = 12 THEN 'other' ELSE 'text' END",
    "label": "CASE seq % 11 WHEN 0 THEN 'page_header' WHEN 4 THEN 'section_header' WHEN 7 THEN 'footnote' WHEN 9 THEN 'list_item' WHEN 10 THEN 'page_footer' ELSE 'text' END",
    "text": "CASE WHEN (seq * 7 + doc_id) % 5 = 0 THEN concat(cast(seq % 9 + 1 AS VARCHAR(9)), ' ', text) WHEN (seq + doc_id) % 4 = 1 THEN replace(text, '.', '') ELSE text END",
    "has_prov": "seq % 19 <> 5",
    "page_no": "cast(floor(seq / 6) AS INT) + 1",
    "bbox_height": "CASE WHEN seq % 17 = 3 THEN NULL ELSE cast(8 + (length(text) % 7) * 4 AS DOUBLE) END",
}
LABELS = {"system": "section_header", "tool": "footnote"}


def _documents(spark, sf_dir, expression: str = "text"):
    return _table(spark, sf_dir, "documents").select("doc_id", F.expr(expression).alias("text"))


def _lines(spark, sf_dir):
    return C.from_documents(_table(spark, sf_dir, "documents"))


def _items(spark, sf_dir):
    df = _lines(spark, sf_dir).select("doc_id", "seq", *(F.expr(e.replace("VARCHAR(9)", "STRING")).alias(f"x_{n}") for n, e in ITEM_COLUMNS.items()), F.length("text").alias("n"))
    return df.select("doc_id", "seq", *(F.col(f"x_{n}").alias(n) for n in ITEM_COLUMNS), F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")).alias("charspan"))


def _conversation_chunks(spark, sf_dir):
    """Turns as chunks: systems are headers, every fifth turn is a footnote, and pages change every third turn."""
    df = _table(spark, sf_dir, "conversations")
    label = F.when(F.col("role") == "system", "section_header").when(F.col("turn") % 5 == 4, "footnote").otherwise("text")
    meta = F.create_map(F.lit("page_#"), F.expr("cast(floor(turn / 3) AS INT) + 1").cast("string"))
    return df.select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("section_no"), F.col("turn").cast("int").alias("seq"), "text", label.alias("label"), meta.alias("meta"))


def _lexicon(spark, sf_dir):
    return words.lexicon_from_text(_table(spark, sf_dir, "benchmark"), "text")


# ---- SQL of the functions ----
# The SQL states characters, patterns and lists for itself, one rule after the other, so that a wrong constant or a wrong
# combination of rules in the functions shows.


def _sql_passes(x: str, *passes: tuple[str, str]) -> str:
    for pattern, by in passes:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def _sql_ligatures(x: str) -> str:
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _sql_misread(x: str) -> str:
    return "translate(" + x + ", 'ÒÓÕÑÐ', '\"\"" + "'" * 2 + "—–')"


def _sql_quotes(x: str) -> str:
    return "translate(" + x + ", '“”‘’', '\"\"" + "'" * 4 + "')"


def _sql_punctuation(x: str) -> str:
    return _sql_passes(x, ("([.!?]) ''", r"\1''"), ('([.!?]) "', r'\1"'), (r"\s+,", ","), (r"(\s)\.([a-zA-Z])", r"\1\2"), (r"\s+\.", "."), (r"\s+\?", "?"), (r"\s+!", "!"))


def _sql_brackets(x: str) -> str:
    return _sql_passes(x, (r"\s+\)", ")"), (r"\s+\]", "]"), (r"\s+\}", "}"), (r"\(\s+", "("), (r"\[\s+", "["), (r"\{\s+", "{"))


def _sql_apostrophes(x: str) -> str:
    return _sql_passes(x, (r"''\s+s(\s|[.,!?;:])", r"''s\1"), (r"\s+''s(\s|$)", r"''s\1"))


def _sql_soft(x: str) -> str:
    return f"regexp_replace({x}, '­\\s?', '', 'g')"


def _sql_footnote(x: str) -> str:
    return rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_][.!?])\s*[\p{{Nd}}]+\s*$', '\1', 'g')"


def _sql_space(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x0B\x1C-\x1F]+', ' ', 'g'))"


def _sql_clean(x: str, footnotes: bool = True) -> str:
    x = _sql_soft(x)
    x = _sql_footnote(x) if footnotes else x
    return _sql_space(_sql_quotes(_sql_apostrophes(_sql_brackets(_sql_punctuation(_sql_misread(_sql_ligatures(x)))))))


def _sql_ends(x: str) -> str:
    return f"""coalesce(regexp_matches({x}, '[.?!][)}}\\]"''”’]?\\z'), false)"""


def _sql_join(x: str, order: str) -> str:
    """Aggregate that joins pieces into a paragraph."""
    s = f"trim({x}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    j = f"string_agg({s} || CASE WHEN {_sql_ends(s)} THEN chr(10) ELSE ' ' END, '' ORDER BY {order}) FILTER ({s} <> '')"
    return f"coalesce(substr({j}, 1, length({j}) - 1), '')"


def _sql_title(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|\P{{L}}+'), lambda p: upper(p[1]) || lower(p[2:])), '')"


def _function(name: str, column, sql: str, source: str = SPOILT):
    """A query of one text function over all documents."""

    def run(spark, sf_dir):
        return _documents(spark, sf_dir, source).select("doc_id", column(F.col("text")).alias("result"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = f"SELECT doc_id, {sql} AS result FROM (SELECT doc_id, {source} AS text FROM documents)"


_function("clean_documents", lambda c: T.clean(T.join_soft_hyphens(c), True), _sql_clean("text"))
_function("soft_hyphens", T.join_soft_hyphens, _sql_soft("text"), SOFT)
_function("drop_soft_hyphens", T.drop_soft_hyphens, "replace(text, '­', '')", SOFT)
_function("strip_footnote_numbers", T.strip_footnote_number, _sql_footnote("text"), "concat(text, ' 12 ')")
_function("ligatures", T.spell_ligatures, _sql_ligatures("text"))
_function("encoding_fix", T.fix_misread, _sql_misread("text"))
_function("punct_spacing", T.space_punctuation, _sql_punctuation("text"))
_function("bracket_spacing", T.space_brackets, _sql_brackets("text"))
_function("apostrophes", T.close_apostrophes, _sql_apostrophes("text"))
_function("quotes", T.straight_quotes, _sql_quotes("text"))
_function("whitespace", T.one_space, _sql_space("text"))
_function("dashes", T.plain_dashes, "translate(text, '—–', '--')", "replace(replace(text, ' de ', ' — '), ' the ', '–')")
_function("title_case", T.title_case, _sql_title("text"), CAPITALS)
_function("normal_lines", T.normal_line, "regexp_replace(lower(text), '[^a-z0-9]', '', 'g')", "replace(text, 'ß', 'ss')")
_function("printable_length", lambda c: T.printable_length(c).cast("bigint"), r"length(regexp_replace(text, '[\p{C}\p{Zl}\p{Zp}\x{A0}]', '', 'g'))::BIGINT", "concat(text, '­ ')")
_function("speech_segments", lambda c: F.size(T.speech_segments(c)).cast("bigint"), r"len(list_filter(regexp_split_to_array(text, '\n+'), lambda s: trim(s) <> ''))::BIGINT", "text")
# characters that decompose into several letters are put in; SQL has no compatibility decomposition, so it spells them out
_function(
    "normal_tokens", T.normal_token,
    r"""lower(regexp_replace(strip_accents(replace(replace(replace(replace(replace(regexp_replace(text, '[.,;:!?"''()\[\]—–-]', '', 'g'), 'ﬁ', 'fi'), 'ﬃ', 'ffi'), 'Ａ', 'A'), '½', '12'), 'Ⓐ', 'A')), '[^\x00-\x7F]', '', 'g'))""",
    "replace(replace(replace(replace(text, 'fi', 'ﬁ'), ' the ', ' Ａﬃ '), ' de ', ' ½ '), ' a ', 'Ⓐ')",
)


@_query(f"SELECT doc_id, seq, {_sql_ends('text')} AS ends, coalesce(regexp_matches(text, '[.?!]\\z'), false) AS punctuated FROM (WITH {LINES} SELECT doc_id, seq, CASE WHEN seq % 3 = 0 THEN text || '\"' ELSE text END AS text FROM lines)")
def sentence_end_flags(spark, sf_dir):
    df = _lines(spark, sf_dir).withColumn("text", F.when(F.col("seq") % 3 == 0, F.concat("text", F.lit('"'))).otherwise(F.col("text")))
    return df.select("doc_id", "seq", T.is_sentence_end(F.col("text")).alias("ends"), T.ends_with_punctuation(F.col("text")).alias("punctuated"))


@_query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n]+'), lambda w: regexp_matches(w, '(?i)^(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$')))::BIGINT AS numerals
FROM (SELECT doc_id, replace(replace(text, ' the ', ' MMMCMXCIX '), ' de ', ' xlix IIII ') AS text FROM documents)""")
def roman_numerals(spark, sf_dir):
    docs = _documents(spark, sf_dir, "replace(replace(text, ' the ', ' MMMCMXCIX '), ' de ', ' xlix IIII ')")
    return docs.select("doc_id", F.size(F.filter(F.split("text", r"[ \t\n]+"), T.is_roman)).cast("bigint").alias("numerals"))


@_query(f"""
SELECT doc_id, replace(CASE WHEN doc_id % 3 = 0 THEN 'IV' || {_sql_title("' ' || t")} ELSE {_sql_title('t')} END, '''S', '''s') AS title
FROM (SELECT doc_id, trim({CAPITALS} || ' X''S') AS t FROM documents)
""")
def enhanced_titles(spark, sf_dir):
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("IV ")).otherwise(F.lit("")), F.expr(CAPITALS), F.lit(" X'S"))
    return _table(spark, sf_dir, "documents").select("doc_id", T.enhance_title(text).alias("title"))


@_query(f"WITH {LINES} SELECT doc_id, {_sql_join('text', 'seq')} AS text FROM lines GROUP BY doc_id")
def build_paragraph(spark, sf_dir):
    lines = _lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("p"))
    return lines.select("doc_id", T.join_pieces(F.transform("p", lambda x: x["text"])).alias("text"))


@_query(f"""WITH {LINES} SELECT doc_id, seq, CASE WHEN regexp_matches(l, 'footnote|endnote|note') THEN 'footnote' WHEN regexp_matches(l, 'body|main|prose|content|paragraph|text') THEN 'body'
WHEN regexp_matches(l, 'index|bibliograph|reference|encyclop|glossar|appendix|contents|header|footer|caption|table') THEN 'drop' ELSE 'none' END AS class
FROM (SELECT doc_id, seq, lower(replace(replace(replace(text, ' the ', ' FOOTNOTE '), ' de ', ' main '), ' and ', ' Table ')) AS l FROM lines)""")
def coerce_class(spark, sf_dir):
    label = F.expr("replace(replace(replace(text, ' the ', ' FOOTNOTE '), ' de ', ' main '), ' and ', ' Table ')")
    return _lines(spark, sf_dir).select("doc_id", "seq", F.coalesce(T.coerce_class(label), F.lit("none")).alias("class"))


_PREFIXED = "CASE doc_id % 4 WHEN 0 THEN '(' || (doc_id % 30) || ') ' WHEN 1 THEN (doc_id % 30) || '. ' WHEN 2 THEN (doc_id % 30) || ') ' ELSE '' END || text"
_UNPREFIXED = "CASE WHEN doc_id % 8 = 0 THEN '7. ' ELSE '' END || text"


@_query(rf"""SELECT doc_id, CASE WHEN regexp_matches(o, '^(\(\d+\)|\d+[.)]) ') AND NOT regexp_matches(c, '^(\(\d+\)|\d+[.)]) ') THEN regexp_extract(o, '^(\(\d+\)|\d+[.)]) ', 0) || c ELSE c END AS text
FROM (SELECT doc_id, {_PREFIXED} AS o, {_UNPREFIXED} AS c FROM documents)""")
def restore_list_prefix(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_PREFIXED).alias("o"), F.expr(_UNPREFIXED).alias("c"))
    return df.select("doc_id", T.restore_list_prefix(F.col("o"), F.col("c")).alias("text"))


@_query(r"""SELECT doc_id, n > 0 AND abs(length(c) - n) / n > 0.10 AS refused FROM (SELECT doc_id, length(regexp_replace(text, '[\p{C}]', '', 'g')) AS n, substr(text, 1, (length(text) * (80 + doc_id % 30) / 100)::INT) AS c FROM
(SELECT doc_id, text FROM documents))""".replace("(length(text) * (80 + doc_id % 30) / 100)::INT", "cast(floor(length(text) * (80 + doc_id % 30) / 100) AS INT)"))
def size_guard(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").withColumn("c", F.expr("substr(text, 1, cast(floor(length(text) * (80 + doc_id % 30) / 100) AS INT))"))
    return df.select("doc_id", T.size_differs(F.col("text"), F.col("c")).alias("refused"))


@_query("""SELECT doc_id, CASE WHEN class = 'footnote' THEN 'footnote' ELSE 'text' END AS label FROM
(SELECT doc_id, CASE WHEN toxic = 1 THEN 'drop' WHEN quality = 0 THEN 'footnote' ELSE 'body' END AS class FROM labels) WHERE class <> 'drop'""")
def class_routing(spark, sf_dir):
    df = _table(spark, sf_dir, "labels").withColumn("class", F.when(F.col("toxic") == 1, "drop").when(F.col("quality") == 0, "footnote").otherwise("body"))
    return df.filter(L.kept_class(F.col("class"), include_footnotes=True)).select("doc_id", F.when(F.col("class") == "footnote", "footnote").otherwise("text").alias("label"))


# ---- paragraphs ----

_LINE_PARAGRAPHS = f"""
WITH RECURSIVE {LINES},
c AS (SELECT doc_id, seq, {_sql_clean('text')} AS text FROM lines),
e AS (SELECT *, {_sql_ends('text')} AS ends, lead(1) OVER (PARTITION BY doc_id ORDER BY seq) IS NULL AS is_last FROM c)"""


@_query(f"""{_LINE_PARAGRAPHS},
g AS (SELECT *, coalesce(sum((ends OR is_last)::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM e),
p AS (SELECT doc_id, max(seq) AS pos, {_sql_join('text', 'seq')} AS text FROM g GROUP BY doc_id, g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS para_no, text, 'text' AS label FROM p WHERE text <> ''""")
def paragraphs_min0(spark, sf_dir):
    return P.paragraphs(_lines(spark, sf_dir)).select("doc_id", "para_no", "text", "label")


@_query(f"""{_LINE_PARAGRAPHS},
f AS (SELECT e.*, 0::BIGINT AS g, CASE WHEN is_last OR (ends AND length(text) >= 400) THEN 0 ELSE length(text) END AS held, (is_last OR (ends AND length(text) >= 400)) AS brk FROM e WHERE seq = 0
  UNION ALL
  SELECT e.*, f.g + f.brk::INT, CASE WHEN e.is_last OR (e.ends AND f.held + length(e.text) >= 400) THEN 0 ELSE f.held + length(e.text) END, (e.is_last OR (e.ends AND f.held + length(e.text) >= 400))
  FROM f JOIN e ON e.doc_id = f.doc_id AND e.seq = f.seq + 1),
p AS (SELECT doc_id, max(seq) AS pos, {_sql_join('text', 'seq')} AS text FROM f GROUP BY doc_id, g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS para_no, text, 'text' AS label FROM p WHERE text <> ''""")
def paragraphs_min400(spark, sf_dir):
    return P.paragraphs(_lines(spark, sf_dir), 400).select("doc_id", "para_no", "text", "label")


@_query(ORACLE["paragraphs_min0"].replace("para_no, text, 'text' AS label FROM p", "para_no, text || chr(10) AS line FROM p"))
def paragraph_listing(spark, sf_dir):
    return sinks.paragraph_lines(P.paragraphs(_lines(spark, sf_dir))).select("doc_id", "para_no", "line")


@_query(f"""WITH d AS ({ORACLE["build_paragraph"]}), s AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\n+'), lambda x: trim(x) <> '') AS s FROM d)
SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS segment_no, unnest(s) AS text FROM s""")
def spoken_segments(spark, sf_dir):
    whole = QUERIES["build_paragraph"](spark, sf_dir).select("doc_id", F.lit(0).alias("section_no"), F.lit(1).alias("para_no"), "text")
    return speech.segments(whole).select("doc_id", "segment_no", "text")


@_query(f"WITH {LINES} SELECT doc_id, 0 AS section_no, seq, text, 'text' AS label, 'page_#: ' || (seq // 6 + 1) AS meta FROM lines")
def document_chunks(spark, sf_dir):
    return C.from_documents(_table(spark, sf_dir, "documents"), lines_per_page=6).withColumn("meta", C.meta_line(F.col("meta")))


_TURNS = """
t AS (SELECT conv_id AS doc_id, turn::INT AS seq, text, CASE WHEN role = 'system' THEN 'section_header' WHEN turn % 5 = 4 THEN 'footnote' ELSE 'text' END AS label,
  (floor(turn / 3)::INT + 1)::VARCHAR AS page FROM conversations)"""
_ATTRIBUTED = f"""
WITH {_TURNS},
a AS (SELECT *, lead(label) OVER w IS NULL AS is_last, label = 'section_header' AS h, {_sql_ends('text')} AS ends FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
b AS (SELECT *, NOT h AND (is_last OR ends) AS brk FROM a WHERE label <> 'footnote'),
c AS (SELECT *, coalesce(sum((h OR brk)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(h::INT) OVER w AS g,
  last_value(CASE WHEN h THEN text END IGNORE NULLS) OVER w AS section, lead(h) OVER w AS before_h, lead(text) OVER w AS next_text, lead(page) OVER w AS next_page FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
p AS (SELECT doc_id, max(seq) AS pos, bool_or(h) AS h, {_sql_join('text', 'seq')} AS joined, arg_max(text, seq) AS last_text, arg_max(label, seq) AS label, arg_max(brk OR h, seq) AS complete,
  coalesce(arg_max(before_h, seq), false) AS cut, arg_max(page, seq) AS page, arg_max(section, seq) AS section, arg_max(next_text, seq) AS next_text, arg_max(next_page, seq) AS next_page FROM c GROUP BY doc_id, g),
q AS (SELECT doc_id, pos, h, CASE WHEN h THEN last_text ELSE joined END AS text, CASE WHEN complete THEN label ELSE 'text' END AS label,
  CASE WHEN complete THEN page WHEN cut THEN next_page END AS page, CASE WHEN NOT complete AND cut THEN next_text ELSE coalesce(section, '') END AS section FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, h)::INT AS para_no FROM q WHERE text <> '')"""


@_query(f"""{_ATTRIBUTED} SELECT doc_id, para_no, text, label, CASE WHEN page IS NULL THEN '' ELSE 'page_#: ' || page || ' | ' END || 'paragraph_#: ' || para_no || CASE WHEN section <> '' THEN ' | section_name: ' || section ELSE '' END AS meta FROM n""")
def section_attribution(spark, sf_dir):
    return P.flat(P.paragraphs(_conversation_chunks(spark, sf_dir), clean=False)).drop("section_no")


@_query(f"""{_ATTRIBUTED} SELECT doc_id, para_no, coalesce(page, '') AS page, coalesce(x.context, '') AS context FROM n
LEFT JOIN (SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS context FROM t GROUP BY ALL) x USING (doc_id, page)""")
def context_lookup(spark, sf_dir):
    chunks = _conversation_chunks(spark, sf_dir)
    return P.with_context(P.paragraphs(chunks, clean=False), P.page_contexts(chunks)).select("doc_id", "para_no", "page", "context")


@_query(f"""{_ATTRIBUTED}, x AS (SELECT doc_id, para_no, page::INT AS page, coalesce(max(page::INT // 10) OVER (PARTITION BY doc_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS seen FROM n WHERE page IS NOT NULL)
SELECT doc_id, para_no, page FROM x WHERE page // 10 > seen""")
def page_progress(spark, sf_dir):
    return sinks.page_progress(P.paragraphs(_conversation_chunks(spark, sf_dir), clean=False)).select("doc_id", "para_no", "page")


@_query(f"WITH {_TURNS} SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS context FROM t GROUP BY ALL")
def page_contexts(spark, sf_dir):
    return P.page_contexts(_conversation_chunks(spark, sf_dir)).drop("section_no")


@_query(f"""WITH {_TURNS} SELECT * FROM (SELECT doc_id, seq, lead(1) OVER w IS NULL AS is_last, coalesce(lead(label) OVER w = 'text', false) AS next_body, coalesce(lead(label) OVER w = 'section_header', false) AS next_header, label FROM t
WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) WHERE label <> 'footnote'""")
def conversation_skip_rules(spark, sf_dir):
    return P.with_look_ahead(_conversation_chunks(spark, sf_dir)).select("doc_id", "seq", "is_last", "next_body", "next_header", "label")


@_query(f"""{_ATTRIBUTED} SELECT doc_id, para_no, '[' || CASE WHEN page IS NULL THEN '' ELSE 'page_#: ' || page || ' | ' END || 'paragraph_#: ' || para_no || CASE WHEN section <> '' THEN ' | section_name: ' || section ELSE '' END || ']' || chr(10) || text || chr(10) AS line FROM n""")
def debug_meta(spark, sf_dir):
    return sinks.meta_lines(P.paragraphs(_conversation_chunks(spark, sf_dir), clean=False)).drop("section_no")


# ---- layout ----

_ITEMS = f"items AS (SELECT doc_id, seq, {', '.join(f'{e} AS {n}' for n, e in ITEM_COLUMNS.items())}, length(text) AS span FROM ({{lines}}))".replace("{lines}", f"WITH {LINES} SELECT * FROM lines").replace("seq / 6", "seq / 6.0")
_METRICS = f"""{_ITEMS},
h AS (SELECT doc_id, coalesce(percentile_disc(0.5) WITHIN GROUP (ORDER BY bbox_height DESC) FILTER (item_kind = 'text' AND label IN ('page_header', 'page_footer') AND has_prov AND bbox_height IS NOT NULL), 0.0) AS line_height FROM items GROUP BY doc_id),
m AS (SELECT doc_id, max(line_height) AS line_height, coalesce(percentile_disc(0.5) WITHIN GROUP (ORDER BY span / (bbox_height / line_height) DESC)
  FILTER (item_kind = 'text' AND label NOT IN ('page_header', 'page_footer') AND has_prov AND bbox_height > 0 AND line_height > 0 AND span >= 100), 0.0) AS line_chars FROM items JOIN h USING (doc_id) GROUP BY doc_id)"""
_SMALL = "item_kind = 'text' AND coalesce(has_prov AND bbox_height > 0 AND line_height > 0 AND line_chars > 0 AND span / (bbox_height / line_height) > line_chars * 1.25, false)"
_SINGLE = "item_kind = 'text' AND coalesce(has_prov AND line_height > 0 AND bbox_height <= line_height * 1.3, false)"


@_query(f"WITH {_METRICS} SELECT doc_id, line_height, line_chars FROM m")
def line_metrics(spark, sf_dir):
    return layout.metrics(_items(spark, sf_dir))


@_query(f"WITH {_METRICS} SELECT doc_id, seq, {_SMALL} AS small_text, {_SINGLE} AS single_line FROM items JOIN m USING (doc_id)")
def small_text(spark, sf_dir):
    items = _items(spark, sf_dir)
    return items.join(layout.metrics(items), "doc_id").select("doc_id", "seq", layout.is_small_text().alias("small_text"), layout.is_single_line().alias("single_line"))


@_query(f"""WITH {_ITEMS} SELECT doc_id, seq, item_kind = 'text' AS bearing, item_kind = 'text' AND label = 'section_header' AS header, item_kind = 'text' AND label = 'page_header' AS page_header, item_kind = 'text' AND label = 'page_footer' AS page_footer,
item_kind = 'text' AND label = 'footnote' AS footnote, item_kind = 'text' AND label = 'list_item' AS list_item, item_kind = 'text' AND label IN ('page_header', 'section_header', 'footnote') AS text_break,
item_kind = 'text' AND label IN ('text', 'list_item', 'formula') AS body, item_kind = 'text' AND length(text) <= 2 AS short, item_kind = 'text' AND label NOT IN ('section_header', 'page_header', 'page_footer') AS text_item,
item_kind <> 'text' OR label IN ('page_header', 'page_footer') AS skipped, page_no BETWEEN 2 AND 3 AS in_range FROM items""")
def item_predicates(spark, sf_dir):
    flags = {"bearing": layout.is_text_bearing(), "header": layout.is_section_header(), "page_header": layout.is_page_header(), "page_footer": layout.is_page_footer(), "footnote": layout.is_footnote(), "list_item": layout.is_list_item(),
             "text_break": layout.is_text_break(), "body": layout.is_body_text(), "short": layout.is_too_short(), "text_item": layout.is_text_item(), "skipped": layout.is_skipped(), "in_range": layout.in_page_range(F.col("page_no"), F.lit(2), F.lit(3))}
    return _items(spark, sf_dir).select("doc_id", "seq", *(c.alias(n) for n, c in flags.items()))


@_query(f"""WITH {_ITEMS}, k AS (SELECT * FROM items WHERE item_kind = 'text' AND label NOT IN ('page_header', 'page_footer'))
SELECT doc_id, seq, seq = min(seq) OVER (PARTITION BY doc_id, page_no) OR seq = max(seq) OVER (PARTITION BY doc_id, page_no) AS is_boundary FROM k""")
def page_boundaries(spark, sf_dir):
    return layout.with_boundaries(_items(spark, sf_dir).filter(~layout.is_skipped())).select("doc_id", "seq", "is_boundary")


@_query(f"""WITH {_ITEMS}, k AS (SELECT *, CASE WHEN item_kind = 'text' AND label NOT IN ('section_header', 'page_header', 'page_footer') THEN seq END AS s FROM items)
SELECT doc_id, seq, coalesce(min(s) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1)::INT AS next_text_seq FROM k""")
def next_text(spark, sf_dir):
    return layout.next_text(_items(spark, sf_dir)).select("doc_id", "seq", F.coalesce("next_text_seq", F.lit(-1)).alias("next_text_seq"))


@_query(f"WITH {_ITEMS} SELECT doc_id, seq, first_value(page_no) OVER (PARTITION BY doc_id, seq // 4 ORDER BY seq) AS paragraph_page FROM items")
def paragraph_page(spark, sf_dir):
    return layout.paragraph_page(_items(spark, sf_dir).withColumn("g", F.floor(F.col("seq") / 4)), "g").select("doc_id", "seq", "paragraph_page")


_CLASSES = rf"""WITH RECURSIVE {_METRICS},
k AS (SELECT items.*, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n, {_SMALL} AS small, {_SINGLE} AS single, seq = min(seq) OVER (PARTITION BY doc_id, page_no) OR seq = max(seq) OVER (PARTITION BY doc_id, page_no) AS edge
  FROM items JOIN m USING (doc_id) WHERE item_kind = 'text' AND label NOT IN ('page_header', 'page_footer')),
s AS (SELECT *, length(text) <= 2 AS short, label = 'text' AND regexp_matches(text, '^[0-9]') AS digit, regexp_matches(text, '\p{{L}}') AS alpha, length(text) >= 100 AND NOT {_sql_ends('text')} AS opens,
  regexp_matches(rtrim(text), '[\p{{L}},:;]\z') AS mid_end FROM k),
r AS (SELECT doc_id, 0::BIGINT AS n, -1 AS page, false AS op, false AS mid, false AS seen, false AS noted, ''::VARCHAR AS class, -1::INT AS seq FROM (SELECT DISTINCT doc_id FROM s)
  UNION ALL
  SELECT doc_id, n, page, CASE WHEN class = 'body' AND label = 'text' THEN opens ELSE op END, CASE WHEN class = 'body' THEN label = 'text' AND mid_end ELSE mid END,
    seen OR (class = 'body' AND label = 'text'), noted OR class = 'note', class, seq FROM (
    SELECT *, CASE WHEN short THEN 'short' WHEN label = 'section_header' AND edge AND single AND op AND mid THEN 'running_head'
      WHEN label = 'footnote' OR (digit AND ((alpha AND (op OR noted)) OR (length(text) >= 100 AND small AND seen))) THEN 'note' ELSE 'body' END AS class FROM (
      SELECT s.doc_id, s.n, s.page_no AS page, s.label, s.text, s.short, s.digit, s.alpha, s.opens, s.mid_end, s.small, s.single, s.edge, s.seq, r.op, r.mid,
        r.seen AND s.page_no = r.page AS seen, r.noted AND s.page_no = r.page AS noted FROM r JOIN s ON s.doc_id = r.doc_id AND s.n = r.n + 1)))"""


@_query(f"{_CLASSES} SELECT doc_id, seq, class FROM r WHERE n > 0")
def footnote_split(spark, sf_dir):
    return layout.classified(_items(spark, sf_dir)).select("doc_id", "seq", "class")


@_query(f"""{_CLASSES}, x AS (SELECT r.doc_id, r.class, r.seq, i.text, i.label, i.page_no FROM r JOIN items i USING (doc_id, seq) WHERE n > 0 AND class IN ('body', 'note') AND page_no BETWEEN 2 AND 4)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY class = 'note', seq)::INT AS seq, text, label, 'page_#: ' || page_no || ' | section_name: ' AS meta FROM x""")
def layout_chunks(spark, sf_dir):
    out = layout.to_chunks(layout.classified(_items(spark, sf_dir)), include_notes=True, start=2, end=4)
    return out.select("doc_id", "seq", "text", "label", C.meta_line(F.col("meta")).alias("meta"))


@_query(f"""{_CLASSES}, x AS (SELECT r.doc_id, CASE WHEN class = 'note' THEN 2 ELSE 0 END AS part, r.seq, CASE WHEN has_prov THEN page_no::VARCHAR ELSE 'N/A' END || ': ' || label || ': ' || text AS line FROM r JOIN items i USING (doc_id, seq) WHERE n > 0 AND class IN ('body', 'note')
UNION ALL SELECT DISTINCT doc_id, 1, 0, '--- FOOTNOTES ---' FROM r WHERE n > 0) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, seq)::INT AS line_no, line FROM x""")
def debug_texts(spark, sf_dir):
    return layout.debug_lines(layout.classified(_items(spark, sf_dir)))


# ---- side lists, lexicon, gate ----


@_query("""SELECT doc_id, first_page, last_page FROM (SELECT doc_id, source, (doc_id % 9)::INT AS page FROM documents)
JOIN (SELECT book_title AS source, arg_max(doc_id % 5, doc_id)::INT AS first_page, arg_max(doc_id % 5 + 2, doc_id)::INT AS last_page FROM (SELECT source AS book_title, doc_id FROM documents) GROUP BY ALL) USING (source)
WHERE page BETWEEN first_page AND last_page""")
def valid_pages(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select(F.concat(F.lit(" "), "source").alias("book_title"), (F.col("doc_id") % 5).cast("string").alias("first_page"), (F.col("doc_id") % 5 + 2).cast("string").alias("last_page"), F.col("doc_id").alias("row_no"))
    ranges = readers.page_ranges(rows).withColumnRenamed("book_title", "source")
    return docs.withColumn("page", (F.col("doc_id") % 9).cast("int")).join(ranges, "source").filter(layout.in_page_range(F.col("page"), F.col("first_page"), F.col("last_page"))).select("doc_id", "first_page", "last_page")


_HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"


@_query(f"""SELECT book_title, item_id, row_number() OVER (PARTITION BY book_title ORDER BY page_id)::INT AS item_no FROM (SELECT {_HOST} AS book_title, 'page-' || page_id AS item_id, page_id FROM pages) WHERE page_id % 7 <> 3""")
def skip_sections(spark, sf_dir):
    items = html_sections.from_pages(_table(spark, sf_dir, "pages"))
    skip = readers.skip_list(items.filter(F.col("item_seq") % 7 == 3).select(F.concat("book_title", F.lit(" ")).alias("book_title"), "item_id"))
    return html_sections.numbered_items(items, skip).select("book_title", "item_id", "item_no")


@_query(r"SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM benchmark) WHERE w <> ''")
def lexicon(spark, sf_dir):
    return _lexicon(spark, sf_dir)


_GATE = rf"""
WITH x AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS word FROM benchmark),
t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[\s\x0B\x1C-\x1F]+'), lambda s: s <> '')) AS w FROM documents),
k AS (SELECT doc_id, regexp_replace(lower(w), '[,;:.!?()''"—–]', '', 'g') AS token FROM t),
b AS (SELECT doc_id, count(*) FILTER (token = '' OR token NOT IN (SELECT word FROM x)) AS n_invalid FROM k GROUP BY doc_id)"""


@_query(f"{_GATE} SELECT doc_id, coalesce(n_invalid, 0)::BIGINT AS n_invalid, coalesce(n_invalid, 0) = 0 AS all_valid FROM documents LEFT JOIN b USING (doc_id)")
def invalid_tokens(spark, sf_dir):
    return words.gate(_documents(spark, sf_dir), ["doc_id"], "text", _lexicon(spark, sf_dir)).select("doc_id", "n_invalid", "all_valid")


@_query(f"{_GATE} SELECT count(*) FILTER (coalesce(n_invalid, 0) = 0)::BIGINT AS n_skipped, count(*) FILTER (n_invalid > 0)::BIGINT AS n_calls FROM documents LEFT JOIN b USING (doc_id)")
def gate_stats(spark, sf_dir):
    return L.gate_stats(words.gate(_documents(spark, sf_dir), ["doc_id"], "text", _lexicon(spark, sf_dir)))


@_query()
def valid_words(spark, sf_dir):
    rules = words.validator(_lexicon(spark, sf_dir))
    tokens = _documents(spark, sf_dir).select(F.explode(words.tokens(F.col("text"))).alias("token")).distinct()
    return tokens.withColumn("valid", words.is_valid_word(spark, rules)("token"))


def _hyphens(spark, sf_dir, seam: str):
    return _documents(spark, sf_dir, f"replace(replace(text, ' the ', '-the '), 'tion', '{seam}')")


_W = r"[\p{L}\p{N}_]+"


@_query(rf"""WITH x AS (SELECT list(DISTINCT w) AS lexicon FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS w FROM benchmark) WHERE w <> ''),
d AS (SELECT doc_id, regexp_extract_all(replace(replace(text, ' the ', '-the '), 'tion', '-tion'), '{_W}-{_W}|{_W}|[^\p{{L}}\p{{N}}_]') AS pieces FROM documents)
SELECT doc_id, array_to_string(list_transform(pieces, lambda p: CASE WHEN regexp_full_match(p, '{_W}-{_W}') AND NOT list_contains(lexicon, lower(split_part(p, '-', 2))) THEN replace(p, '-', ' - ') ELSE p END), '') AS text FROM d, x""")
def dash_hyphens(spark, sf_dir):
    return words.open_dashes(_hyphens(spark, sf_dir, "-tion"), "text", words.validator(_lexicon(spark, sf_dir)))


@_query()
def hyphen_join(spark, sf_dir):
    rules = words.validator(_lexicon(spark, sf_dir))
    return _hyphens(spark, sf_dir, "­ tion").select("doc_id", words.join_hyphens(spark, rules)("text").alias("text"))


@_query()
def restore_valid_words(spark, sf_dir):
    rules = words.validator(_lexicon(spark, sf_dir))
    changed = F.replace(F.replace("text", F.lit(" the "), F.lit(" teh ")), F.lit("tion "), F.lit("ti on "))
    return _documents(spark, sf_dir).select("doc_id", words.restore_words(spark, rules)("text", changed).alias("text"))


class _Echo:
    """A stand-in for a model: it repairs nothing and takes paragraphs that begin with a digit for notes."""

    def complete(self, system: str, user: str) -> str:
        import json

        text = user.rsplit("Paragraph to clean and classify:\n", 1)[1]
        return json.dumps({"cleaned": text, "classification": "Footnote!" if text[:1].isdigit() else "body"})


@_query()
def cleaned_paragraphs(spark, sf_dir):
    step = L.Cleaner(_Echo, words.validator(_lexicon(spark, sf_dir)))
    return P.paragraphs(_lines(spark, sf_dir), cleaner=step).select("doc_id", "para_no", "text", "label")


# ---- sections of HTML, audio, comparison ----


# The pages hold a list of links, one h1, paragraphs, some of which are never closed and begin with bold words and a line
# break, and a footer; a few break off. So leaves can be read from the order of tags.
_PAGE_LEAVES = r"""
WITH b AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS book_title, regexp_extract(html, '(?is)<body[^>]*>(.*?)(?:</body\s*>|\z)', 1) AS body FROM pages),
i AS (SELECT *, row_number() OVER (PARTITION BY book_title ORDER BY page_id) AS item_no FROM b),
k AS (SELECT page_id, unnest(regexp_extract_all(body, '<!--.*?-->|</?[a-zA-Z][^>]*>[^<]*')) AS t, generate_subscripts(regexp_extract_all(body, '<!--.*?-->|</?[a-zA-Z][^>]*>[^<]*'), 1) AS n FROM i),
t AS (SELECT page_id, n, regexp_extract(t, '^<(/?[a-zA-Z0-9]+)', 1) AS tag, replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '^<[^>]*>', ''), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS txt FROM k WHERE NOT starts_with(t, '<!--')),
w AS (SELECT *, lead(tag) OVER o AS tag1, lead(txt) OVER o AS txt1, lead(tag, 2) OVER o AS tag2, lead(txt, 2) OVER o AS txt2, lead(tag, 3) OVER o AS tag3,
  count(*) FILTER (tag = 'nav') OVER o - count(*) FILTER (tag = '/nav') OVER o AS in_nav FROM t WINDOW o AS (PARTITION BY page_id ORDER BY n)),
l AS (SELECT page_id, min(n) AS n, 'nav' AS tag, string_agg(txt, '' ORDER BY n) AS txt FROM w WHERE in_nav > 0 GROUP BY page_id
  UNION ALL SELECT page_id, n, tag, txt FROM w WHERE tag IN ('h1', 'footer')
  UNION ALL SELECT page_id, n, tag, CASE WHEN tag1 = 'b' THEN txt || txt1 || CASE WHEN tag2 = 'br' THEN ' ' || txt2 ELSE '' END ELSE txt END FROM w
    WHERE tag = 'p' AND coalesce(tag1, '') <> 'p' AND NOT (coalesce(tag1, '') = 'b' AND (coalesce(tag2, '') = 'p' OR (coalesce(tag2, '') = 'br' AND coalesce(tag3, '') = 'p')))),
h AS (SELECT page_id, CASE WHEN regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '\p{Ll}') THEN """ + _sql_title("t") + r""" ELSE t END AS title, first_n FROM (SELECT page_id, trim(any_value(txt)) AS t, min(n) AS first_n FROM l WHERE tag = 'h1' AND trim(txt) <> '' GROUP BY page_id)),
c AS (SELECT page_id, -1 AS n, title AS text, 'section_header' AS label, title AS chapter, NULL AS section FROM h
  UNION ALL SELECT l.page_id, l.n, CASE WHEN l.tag = 'h1' THEN title ELSE l.txt END, CASE WHEN l.tag = 'h1' THEN 'section_header' ELSE 'text' END, CASE WHEN l.tag <> 'h1' THEN title END, CASE WHEN l.n >= first_n THEN title END
  FROM l LEFT JOIN h USING (page_id) WHERE trim(l.txt) <> '')"""


@_query(f"""{_PAGE_LEAVES} SELECT item_no::INT AS section_no, (row_number() OVER (PARTITION BY page_id ORDER BY n) - 1)::INT AS seq, text, label,
  'book_title: ' || book_title || coalesce(' | chapter_title: ' || chapter, '') || ' | item_#: ' || item_no || ' | item_id: page-' || page_id || coalesce(' | section_name: ' || section, '') AS meta FROM c JOIN i USING (page_id)""")
def html_chunks(spark, sf_dir):
    chunks = html_sections.to_chunks(html_sections.from_pages(_table(spark, sf_dir, "pages")))
    return chunks.select("section_no", "seq", "text", "label", C.meta_line(F.col("meta")).alias("meta"))


@_query(f"""{_PAGE_LEAVES.replace("WITH b AS", "WITH RECURSIVE b AS")},
q AS (SELECT page_id, n, label = 'section_header' AS h, chapter, {_sql_clean("text")} AS text FROM c),
e AS (SELECT *, row_number() OVER w AS k, lead(h) OVER w AS before_h, lead(text) OVER w AS next_text, lead(chapter) OVER w AS next_chapter, {_sql_ends("text")} AS ends FROM q WINDOW w AS (PARTITION BY page_id ORDER BY n)),
f AS (SELECT page_id, 0::BIGINT AS k, 0::BIGINT AS held, false AS brk FROM (SELECT DISTINCT page_id FROM e)
  UNION ALL SELECT page_id, k, CASE WHEN h OR brk THEN 0 ELSE held END, brk FROM (SELECT e.page_id, e.k, e.h, f.held + length(e.text) AS held,
    NOT e.h AND (e.before_h IS NULL OR (e.ends AND (e.before_h OR f.held + length(e.text) >= 5))) AS brk FROM f JOIN e ON e.page_id = f.page_id AND e.k = f.k + 1)),
g AS (SELECT e.*, f.brk, coalesce(sum((h OR brk)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(h::INT) OVER w AS g,
  last_value(CASE WHEN h THEN text END IGNORE NULLS) OVER w AS heading FROM e JOIN f USING (page_id, k) WINDOW w AS (PARTITION BY page_id ORDER BY k)),
p AS (SELECT page_id, max(k) AS pos, bool_or(h) AS h, {_sql_join("text", "k")} AS joined, arg_max(text, k) AS last_text, arg_max(brk OR h, k) AS complete, coalesce(arg_max(before_h, k), false) AS cut,
  arg_max({{'x': chapter}}, k).x AS chapter, arg_max({{'x': next_chapter}}, k).x AS next_chapter, arg_max(heading, k) AS heading, arg_max(next_text, k) AS next_text FROM g GROUP BY page_id, g),
r AS (SELECT page_id, pos, h, CASE WHEN h THEN last_text ELSE joined END AS text, CASE WHEN complete AND h THEN 'section_header' ELSE 'text' END AS label, CASE WHEN complete THEN chapter ELSE next_chapter END AS chapter,
  CASE WHEN NOT complete AND cut THEN next_text ELSE coalesce(heading, '') END AS heading FROM p),
m AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos, h)::INT AS para_no FROM r WHERE text <> '')
SELECT item_no::INT AS section_no, para_no, text, label, 'book_title: ' || book_title || coalesce(' | chapter_title: ' || chapter, '') || ' | item_#: ' || item_no || ' | item_id: page-' || page_id
  || ' | paragraph_#: ' || para_no || CASE WHEN heading <> '' THEN ' | section_name: ' || heading ELSE '' END AS meta FROM m JOIN i USING (page_id)""")
def html_paragraphs(spark, sf_dir):
    return P.flat(P.paragraphs(html_sections.to_chunks(html_sections.from_pages(_table(spark, sf_dir, "pages"))), 5)).drop("doc_id")


@_query(f"WITH {LINES} SELECT doc_id, 24000 AS sample_rate, sum(2 * 24 * length(text))::BIGINT AS pcm_bytes FROM lines GROUP BY doc_id")
def audio(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("para_no", F.col("seq"))
    return speech.lengths(speech.in_order(speech.synthesised(lines, speech.ToneEngine)))


@_query(rf"""WITH {LINES}, r AS (SELECT doc_id, seq AS line_no, text AS a, CASE WHEN seq % 5 = 2 THEN text || ' extra words' WHEN seq % 5 = 3 THEN replace(replace(text, 'tion', 'shon'), 'e', 'é') ELSE upper(replace(text, 'ß', 'ss')) END AS b FROM lines),
w AS (SELECT *, regexp_split_to_array(trim(regexp_replace(lower(a), '[\s\x0B]+', ' ', 'g')), ' ') AS x, regexp_split_to_array(trim(regexp_replace(lower(b), '[\s\x0B]+', ' ', 'g')), ' ') AS y FROM r
  WHERE regexp_replace(lower(a), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(b), '[^a-z0-9]', '', 'g')),
p AS (SELECT doc_id, line_no, a, b, len(x) = len(y) AS even, unnest(list_zip(x, y)) AS z FROM w),
v AS (SELECT *, regexp_replace(z[1], '[^a-z]', '', 'g') AS p, regexp_replace(z[2], '[^a-z]', '', 'g') AS q FROM p),
s AS (SELECT *, levenshtein(p, q) AS d, length(p) + length(q) AS n, abs(length(p) - length(q)) AS k, list_sort(string_split(p, '')) = list_sort(string_split(q, '')) AS same FROM v)
SELECT doc_id, line_no, a, b FROM s GROUP BY ALL HAVING NOT bool_and(even AND (p = q OR 5 * (CASE WHEN d = 2 AND same THEN 2 ELSE 2 * d - k END) <= n))""")
def differing_lines(spark, sf_dir):
    left = _lines(spark, sf_dir).select("doc_id", F.col("seq").alias("line_no"), F.col("text").alias("line"))
    spelt = F.replace(F.replace("line", F.lit("tion"), F.lit("shon")), F.lit("e"), F.lit("é"))
    right = left.withColumn("line", F.when(F.col("line_no") % 5 == 2, F.concat("line", F.lit(" extra words"))).when(F.col("line_no") % 5 == 3, spelt).otherwise(F.upper(F.replace("line", F.lit("ß"), F.lit("ss")))))
    return compare.differing_lines(left, right)


@_query(f"WITH {_ITEMS} SELECT doc_id, seq AS line_no, CASE label WHEN 'section_header' THEN '## ' WHEN 'list_item' THEN '- ' ELSE '' END || text || chr(10) AS line FROM items WHERE item_kind = 'text' AND label NOT IN ('page_header', 'page_footer')")
def markdown(spark, sf_dir):
    return sinks.markdown_lines(_items(spark, sf_dir))


@_query(f"WITH {_ITEMS}, n AS (SELECT doc_id, max(page_no) AS pages FROM items GROUP BY doc_id) SELECT doc_id, seq, page_no FROM items JOIN n USING (doc_id) WHERE page_no = 1")
def page_slice(spark, sf_dir):
    return layout.page_slice(_items(spark, sf_dir), 1, 1).select("doc_id", "seq", "page_no")
