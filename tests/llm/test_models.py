"""Held-out accuracy of what is trained, and the pipeline, on the driver's small tables."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirefold.llm import language_id, ngram_join, perfect_hash, quality_classifier, tool_calls

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@needs_data
def test_language_accuracy(spark):
    out = language_id.query(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def bayes(rows):
    """Posteriors by counting every gram of every text, one by one. rows: (doc_id, text, lang)."""
    import collections
    import math
    import zlib

    def grams(text):
        chars = []
        for c in text.lower():
            chars += [c] if c.isalpha() else [" "] if chars and chars[-1] != " " else []
        chars += [" "] if chars and chars[-1] != " " else []
        for k, c in enumerate(chars):
            for order in (1, 2, 3):
                if order > 1 or c != " ":
                    yield order, "".join(chars[max(0, k - order + 1) : k + 1]).rjust(order)

    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[2] is not None]
    langs = sorted({r[2] for r in learnt})
    counts = {x: collections.Counter(g for r in learnt if r[2] == x for g in grams(r[1] or "")) for x in langs}
    sums = {(x, order): sum(n for (o, _), n in counts[x].items() if o == order) + 0.5 * 65536 for x in langs for order in (1, 2, 3)}
    for doc_id, text, _ in rows:
        own = list(grams(text or ""))
        if not any(o == 1 for o, _ in own) or not langs:
            yield doc_id, "und", 0.0
            continue
        score = {x: math.log((sum(r[2] == x for r in learnt) + 1) / (len(learnt) + len(langs))) + sum(math.log((counts[x][g] + 0.5) / sums[x, g[0]]) for g in own) for x in langs}
        best = max(langs, key=lambda x: (score[x], [-ord(c) for c in x]))
        yield doc_id, best, 1 / sum(math.exp(score[x] - score[best]) for x in langs)


@pytest.mark.parametrize("together", [1, 2, 64])
def test_language_against_counting(spark, together, monkeypatch):
    """Equal to counting grams without hashing (no two grams of these texts share a place), whatever is compared at once."""
    monkeypatch.setattr(language_id, "TOGETHER", together)
    words = {"en": "the cat sat on a mat and ran", "fr": "le chat sur la table et où été", "de": "die katze für öl und straße", "xx": "漢字 仮名 文字"}
    rows = []
    for k in range(60):
        lang = list(words)[k % 4]
        own = words[lang].split()
        rows.append((k, " ".join(own[(k + j) % len(own)] for j in range(1 + k % 5)) + ("!" if k % 7 else " 12"), lang if k % 9 else None))
    rows += [(100, None, "en"), (101, "", "fr"), (102, "12 !!", "de"), (103, "Zebra", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(df).collect()}
    for doc_id, lang, score in bayes(rows):
        assert found[doc_id][0] == lang, doc_id
        assert abs(found[doc_id][1] - score) < 1e-3, doc_id


def test_language_without_rows_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language_id.language_id(df).collect()} == {("und", 0.0)}


@needs_data
def test_quality_accuracy(spark):
    out = quality_classifier.query(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out")
    rates = {r.quality: r.kept for r in out.groupBy("quality").agg(F.avg("predicted").alias("kept")).collect()}
    assert rates[1] > 0.9
    assert rates[0] < 0.3


def test_quality_is_the_difference_of_compressed_sizes(spark, folder, rows):
    """Scores equal those computed block by block from the model's dictionaries, and labels of the held-out fold teach
    nothing."""
    import math
    import zlib

    import zstandard

    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    known = labels.select("doc_id", "quality").filter("doc_id is not null")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality_classifier.fit(docs.select("doc_id", "text"), known.filter(~held_out))
    assert "weights" in model

    def size(text, content):
        made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), level=1, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(made.compress(text[k : k + 256])) for k in range(0, len(text), 256))

    def score(text):
        apart, damp = (size(text, model["bad"]) - size(text, model["good"])) / (len(text) + 64), 1 / (1 + len(text) / 200)
        return 1 / (1 + math.exp(-sum(w * x for w, x in zip(model["weights"], (apart, apart * damp, damp, 1), strict=True))))

    wanted = {(r[0], r[1]): score((r[1] or "").encode()) for r in rows}
    found = quality_classifier.quality_classifier(docs, labels).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in found:
        if r.doc_id != 0:  # its rows have several labels only, not several texts
            assert math.isclose(r.score, wanted[r.doc_id, r.text], rel_tol=1e-9), r.doc_id
            assert r.predicted == (wanted[r.doc_id, r.text] >= 0.3)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    turned = labels.withColumn("quality", F.when(held_out, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_classifier.quality_classifier(docs, turned)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, quality_classifier.quality_classifier(docs, labels).collect()), key=str)


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0)])
def test_quality_with_little_to_learn(spark, labels, score):
    docs = spark.createDataFrame([(1, "a b c", 9.0), (2, None, None)], "doc_id long, text string, score double")
    out = quality_classifier.quality_classifier(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert [r.score for r in out] == [score, score]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        found = perfect_hash.PerfectHash.load(*perfect_hash.PerfectHash.build(keys).dump())
        assert sorted(found.index(keys).tolist()) == list(range(len(keys)))
        others = found.index(rng.integers(0, 2**63, 100).astype(np.uint64))
        assert ((others >= -1) & (others < max(len(keys), 1))).all()


def test_line_index_tells_lines_of_one_hash_apart():
    """Two lines that share all 64 bits of a hash keep their own counts."""
    from quirefold.llm.line_dedup import LineIndex

    rng = np.random.default_rng(4)
    keys, prints = np.sort(rng.integers(0, 2**63, 500).astype(np.uint64)), rng.integers(0, 2**63, 500).astype(np.uint64)
    keys[101] = keys[100]
    prints[100:102] = np.sort(prints[100:102])
    counts, top = np.arange(1, 501), np.arange(500) - 250
    own = LineIndex.load(LineIndex.build(keys, prints, counts, top).dump())
    assert [x.tolist() for x in own.probe(keys, prints)] == [counts.tolist(), top.tolist()]
    assert not own.probe(keys, prints ^ np.uint64(1 << 20))[0].any()
    assert not own.probe(rng.integers(0, 2**63, 500).astype(np.uint64), prints)[0].any()


@pytest.mark.parametrize("together", [1, 32])
def test_divide_skip_equals_counting(together, monkeypatch):
    monkeypatch.setattr(ngram_join, "TOGETHER", together)
    rng = np.random.default_rng(2)
    base = rng.choice(5000, 120, replace=False).astype(np.uint64)
    sets = []
    for _ in range(80):
        own = base.copy()
        own[rng.choice(120, rng.integers(0, 30), replace=False)] += np.uint64(10_000)
        sets.append(np.unique(own[: rng.integers(90, 121)]))
    for percent in (60, 85):
        index = ngram_join.Inverted(sets, percent)
        for q in range(len(sets)):
            wanted = {y for y in range(q) if 100 * len(np.intersect1d(sets[q], sets[y])) >= percent * len(np.union1d(sets[q], sets[y]))}
            assert {*index.search(q, lambda _: False)} == wanted


def test_levels(spark):
    chain = [(f"n{k}", f"n{k - 1}") for k in range(300)]
    rows = [*chain, ("a", None), ("b", "a"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "y"), ("q", "gone"), (None, "a")]
    out = {r.id: r.level for r in tool_calls.levels(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert all(out[f"n{k}"] == k for k in range(300))
    assert (out["a"], out["b"], out["q"], out["x"], out["y"], out["z"]) == (0, 1, 0, None, None, None)


def test_levels_of_nodes_with_several_parents(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("d", "c"), ("e", "d"), ("e", "gone"), ("x", "y"), ("y", "x"), ("z", "a"), ("z", "x")]
    out = {r.id: r.level for r in tool_calls.levels(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert out == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "x": None, "y": None, "z": None}


def test_tool_calls(spark):
    calls = [("1", 1, "a", "reply", '{"turn": 3, "text":"x", "b":{"z":1,"a":[1, 2]}}'), ("1", 1, "b", "reply", '{"turn":"3"}'), ("1", 2, "c", "nope", "{}"), ("1", 3, "d", "reply", "xx"), (None, 4, None, "configure", '{"text":"","turn":1}'),
             ("1", 8, "a", "reply", '{"turn": 8, "text":"again"}'), ("1", 8, "a", "reply", '{"turn": 8, "text":"again"}')]
    results = [("1", 5, "a", "ok"), ("1", 9, "a", "late"), ("1", 6, "zz", None), (None, 7, None, "of nothing"), ("1", 1, "c", "early")]
    out = tool_calls.link(spark.createDataFrame(calls, "conv_id string, turn int, call_id string, name string, arguments string"), spark.createDataFrame(results, "conv_id string, turn int, call_id string, content string")).collect()
    rows = {r.call_id: r for r in out if r.call_id and not any(e.startswith("repeated") for e in r.errors)}
    assert rows["a"].json == '{"call":{"arguments":{"b":{"a":[1,2],"z":1},"text":"x","turn":3},"name":"reply","turn":1},"errors":[],"id":"a","result":{"content":"ok","turn":5},"valid":true}'
    assert (rows["a"].n_calls, rows["a"].n_results, rows["a"].result_turn) == (3, 2, 5)
    assert [rows[k].errors for k in ("b", "c", "zz")] == [["text: missing", "turn: not integer"], ["unknown tool", "result before call"], ["no call"]]
    assert rows["d"].errors[0] == "not an object"
    assert rows["zz"].json == '{"call":null,"errors":["no call"],"id":"zz","result":{"content":null,"turn":6},"valid":false}'
    again = {tuple(r.errors): r for r in out if r.call_id == "a" and not r.valid}
    assert again["repeated call",].n_copies == 2
    assert '"text":"again"' in again["repeated call",].json
    assert '"content":"late"' in again["repeated result",].json
    assert {(r.turn, r.result_turn, *r.errors) for r in out if r.call_id is None} == {(4, None, "text: too short", "turn: too large"), (None, 7, "no call")}


def test_lost_turns_are_answered_by_nothing(spark):
    turns = [(1, None, "user", "lost"), (1, 0, "assistant", "first"), (1, 7, "user", "late"), (1, 9, "assistant", "answer"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), ("", 0, "user", "c")]
    calls, results, nodes = tool_calls.turns_as_calls(spark.createDataFrame([(None if c is None else str(c), *r) for c, *r in turns], "conv_id string, turn long, role string, text string"))
    out = tool_calls.link(calls, results).collect()
    assert {(r.conv_id, r.turn, r.result_turn) for r in out} == {("1", None, None), ("1", None, 0), ("1", 7, 9), (None, 0, None), (None, None, 1), ("", 0, None)}
    assert {r.id: r.level for r in tool_calls.levels(nodes).collect()} == {"1:0": 0, "1:7": 1, "1:9": 2, ":0": 0}


def test_previous_turns_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(tool_calls, "TURNS", 4)
    there = [0, 1, 3, 9, 10, 40, 41, 42, 43, 44]
    out = tool_calls.with_previous(spark.createDataFrame([("x", t) for t in there * 2], "conv_id string, turn long")).collect()
    assert {r.turn: r.before for r in out} == dict(zip(there, [None, *there[:-1]], strict=True))


@needs_data
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        rows = out.collect()
        if name == "encode":
            assert all(r.round_trip for r in rows)
        else:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, out.schema)
        seen[name] = rows
    sizes = {k: len(v) for k, v in seen.items()}
    assert sizes["quality"] == sizes["line_dedup"] > sizes["near_dups"] > sizes["decontaminate"] == sizes["encode"] > 500
    # each stage leaves nothing for itself to do
    left = spark.createDataFrame(seen["near_dups"], docs.schema)
    assert ngram_join.keep_one(left, 5, 80).count() == sizes["near_dups"]


def row_key(r):
    return tuple(map(str, r))


def test_stages_on_awkward_rows(spark, folder, rows):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns through every stage, one by one."""
    import collections

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        found = out.collect()
        if name == "encode":
            assert len(found) == docs.count()
            assert all(r.round_trip for r in found)
            continue
        assert out.columns == docs.columns, name
        before = collections.Counter(row_key(r) for r in docs.collect())
        if name != "line_dedup":  # what stays is as it was
            assert not collections.Counter(map(row_key, found)) - before, name
        else:
            assert len(found) == sum(before.values())
        if name in ("near_dups", "decontaminate"):
            assert any(r.text is None for r in found), name
        docs = spark.createDataFrame(found, docs.schema)


def test_keep_good_is_the_query(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    kept = quality_classifier.keep_good(docs, labels)
    wanted = quality_classifier.quality_classifier(docs, labels).filter("predicted = 1")
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    assert kept.columns == docs.columns
    assert ids(kept) == ids(wanted)


def test_stages_on_empty_tables(spark, empty):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, empty).count() == 0
    assert corpus_pipeline.run(spark, empty).count() == 0


@needs_data
def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 500
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dups", "decontaminate", "encode"]
