"""Queries over whole texts, against step-by-step restatements on small tables of long texts."""

import pytest
from test_paragraphs import one_by_one

from quirefold.plans import catalog


def said(turn):
    return f"turn {turn} goes on for a good deal more than sixty characters, " * 3 + ("and ends." if turn % 2 else "and does not")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    rows = [(c, t, "system" if t == 3 * c else "user", said(t)) for c in (1, 2) for t in range(12)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{out}/conversations.parquet")
    docs = [(k, "\n".join(f"line {n} of some words, more than sixty characters in all of them" for n in range(k + 3))) for k in range(1, 9)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{out}/documents.parquet")
    return out


def chunks(conv):
    return [(said(t), "section_header" if t == 3 * conv else "footnote" if t % 5 == 4 else "text", {"page_#": str(t // 3 + 1)}) for t in range(12)]


def test_turns_are_whole(spark, folder):
    wanted = [(c, n, text, label) for c in (1, 2) for n, text, label, _ in one_by_one(chunks(c), 0, False)]
    assert sorted((r.doc_id, r.para_no, r.text, r.label) for r in catalog.QUERIES["section_attribution"](spark, folder).collect()) == sorted(wanted)
    contexts = {(c, str(p + 1)): "\n\n".join(said(t) for t in range(3 * p, 3 * p + 3)) for c in (1, 2) for p in range(4)}
    assert {(r.doc_id, r.page): r.context for r in catalog.QUERIES["page_contexts"](spark, folder).collect()} == contexts
    assert {r.context for r in catalog.QUERIES["context_lookup"](spark, folder).collect()} - {""} <= {*contexts.values()}
    lines = [r.line for r in catalog.QUERIES["debug_meta"](spark, folder).collect()]
    assert sorted(x.split("]\n", 1)[1] for x in lines) == sorted(f"{text}\n" for _, _, text, _ in wanted)


def test_documents_are_whole(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    result = lambda name: {r[0]: r[1] for r in catalog.QUERIES[name](spark, folder).collect()}
    assert result("title_case") == {k: t.title() for k, t in texts.items()}
    assert result("enhanced_titles") == {k: "IV " * (k % 3 == 0) + t.title() + " X's" for k, t in texts.items()}
    prefix = {0: "({}) ", 1: "{}. ", 2: "{}) ", 3: ""}
    assert result("restore_list_prefix") == {k: ("7. " if k % 8 == 0 else prefix[k % 4].format(k % 30)) + t for k, t in texts.items()}


def test_numerals_and_classes_are_of_the_texts(spark, tmp_path):
    rows = [(1, "chapter XIX of iv\nFOOTNOTE here"), (2, "no numeral\nsee the INDEX\nplain"), (3, "IIII VX dcl")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in catalog.QUERIES["roman_numerals"](spark, str(tmp_path)).collect()} == {(1, 2), (2, 1), (3, 1)}
    classes = {(r.doc_id, r.seq): r["class"] for r in catalog.QUERIES["coerce_class"](spark, str(tmp_path)).collect()}
    assert classes == {(1, 0): "none", (1, 1): "footnote", (2, 0): "none", (2, 1): "footnote", (2, 2): "none", (3, 0): "none"}


def test_no_query_cuts_texts():
    import inspect

    for name, query in catalog.QUERIES.items():
        if name != "size_guard":  # its feature: it compares a text with a shorter version of it
            assert "substr" not in inspect.getsource(query), name
