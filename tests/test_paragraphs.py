import random

import pytest

from quirefold.operators import chunks as C
from quirefold.operators import paragraphs as P


def ends(t):
    return bool(t) and (t[-1] in ".?!" or (len(t) > 1 and t[-1] in ")}]\"'”’" and t[-2] in ".?!"))


def joined(pieces):
    out = ""
    for piece in (p.strip() for p in pieces):
        out = piece if not out else (out + ("\n" if ends(out) else " ") + piece).strip()
    return out


def one_by_one(chunks, min_size, notes):
    """The rules of assembly, applied to one chunk after the other."""
    out, held, section, n = [], [], "", 0

    def emit(text, label, meta):
        nonlocal n
        if text:
            n += 1
            out.append((n, text, label, {**meta, "paragraph_#": str(n), **({"section_name": section} if section else {})}))

    for k, (text, label, meta) in enumerate(chunks):
        after = chunks[k + 1][1] if k + 1 < len(chunks) else None
        if label in C.PAGE_EDGES or (label == "footnote" and not notes):
            continue
        if label in C.HEADERS:
            section = text
            emit(joined(held), "text", meta)
            held = []
            emit(text, label, meta)
            continue
        held.append(text)
        if after is None or (ends(text) and (after not in C.BODY or sum(map(len, held)) >= min_size)):
            emit(joined(held), label, meta)
            held = []
    emit(joined(held), "text", {})
    return out


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(3)
    labels = ["text"] * 6 + ["section_header", "h2", "footnote", "page_header", "list_item", "", "formula"]
    texts = ["", "Ab.", "cd", "Ef gh!", 'Quo."', "x (y.)", "long text here", "Done?", " sp. "]
    metas = [{"page_#": "1"}, {"page_#": "2", "x": "y"}, {}, {"section_name": ""}]
    return [[(rng.choice(texts), rng.choice(labels), rng.choice(metas)) for _ in range(rng.randint(0, 14))] for _ in range(150)]


@pytest.mark.parametrize(("min_size", "notes"), [(0, False), (0, True), (8, False), (12, True)])
def test_assembly(spark, documents, min_size, notes):
    rows = [(d, 0, k, *c) for d, chunks in enumerate(documents) for k, c in enumerate(chunks)]
    got = {}
    for r in P.paragraphs(spark.createDataFrame(rows, C.CHUNK), min_size, notes, clean=False).collect():
        got.setdefault(r.doc_id, []).append((r.para_no, r.text, r.label, r.meta))
    for d, chunks in enumerate(documents):
        assert sorted(got.get(d, []), key=lambda x: x[0]) == one_by_one(chunks, min_size, notes)


def test_nulls_and_empty(spark):
    rows = [(1, 0, 0, None, None, None), (1, 0, 1, "A.", "text", None)]
    assert [r.text for r in P.paragraphs(spark.createDataFrame(rows, C.CHUNK)).collect()] == ["A."]
    for size in (0, 9):
        assert P.paragraphs(spark.createDataFrame([], C.CHUNK), size).count() == 0


def test_contexts(spark):
    rows = [(1, 0, 0, "a", "text", {"page_#": "1"}), (1, 0, 1, "b.", "footnote", {"page_#": "1"}), (1, 0, 2, "c.", "text", {}), (1, 0, 3, "d.", "text", {"page_#": "2"})]
    df = spark.createDataFrame(rows, C.CHUNK)
    assert {(r.page, r.context) for r in P.page_contexts(df).collect()} == {("1", "a\n\nb."), ("2", "d.")}
    found = P.with_context(P.paragraphs(df, clean=False), P.page_contexts(df)).orderBy("para_no").collect()
    assert [(r.text, r.page, r.context) for r in found] == [("a c.", "", ""), ("d.", "2", "d.")]


def test_plan_has_one_exchange(spark):
    df = spark.createDataFrame([(1, 0, 0, "a.", "text", {})], C.CHUNK)
    plan = P.paragraphs(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan
