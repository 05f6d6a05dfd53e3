"""The ten queries on small tables with every awkward row, against brute force or SQL."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quirefold.llm import byte_bpe, context_tree, decontaminate, line_dedup, ngram_join, quality_rules, registry, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id, mod):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def got(spark, name, folder):
    """Rows by id; rows of one id must be equal but for those of null ids and of op1."""
    out = collections.defaultdict(list)
    for r in registry.QUERIES[name](spark, folder).collect():
        out[r.doc_id].append(r)
    return out


def texts_of(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[0]].append(r[1])
    return out


def held_against(found, rows, wanted):
    """wanted(doc_id, text) gives the leading columns of a row."""
    texts = texts_of(rows)
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in texts.items()}
    for doc_id, own in texts.items():
        n = len(wanted(doc_id, own[0]))
        key = lambda x: tuple(map(str, x))
        assert sorted((tuple(r[1 : n + 1]) for r in found[doc_id]), key=key) == sorted((wanted(doc_id, t) for t in own), key=key), doc_id


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", ["op6_quality_rules", "op9_tool_calls"])
def test_native_against_sql(spark, folder, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    a, b = registry.QUERIES[name](spark, folder).toPandas(), db.execute(registry.ORACLE[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    if name.startswith("op6"):  # SQL groups the windows of repeated rows together
        a, b = (x[x.doc_id.notna() & ~x.doc_id.isin([0, 11])].astype({"doc_id": "int64"}) for x in (a, b))
    plain = lambda x: sorted(map(tuple, x[columns].astype(str).to_numpy().tolist()))
    assert plain(a) == plain(b)
    plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def quality_of(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for k in range(len(words) - 4):
        at[tuple(words[k : k + 5])].append(k)
    covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_stop_words_are_those_of_the_sql(spark, written_documents):
    """Each word of either list counts alike, in any case and before a comma or a full stop."""
    import duckdb

    listed = set(re.findall(r"'([^']+)'", quality_rules._STOP_SQL))
    words = sorted(listed | set(quality_rules.STOP_WORDS) | {"una"})
    folder = written_documents([*enumerate(words), (1000, "Una casa, una mesa y UNA. una, silla " * 3), (1001, " ".join(words))])
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    wanted = db.execute(f"SELECT doc_id, n_stop, kept FROM ({registry.ORACLE['op6_quality_rules']}) ORDER BY doc_id").fetchall()
    assert [(r.doc_id, r.n_stop, r.kept) for r in registry.QUERIES["op6_quality_rules"](spark, folder).orderBy("doc_id").collect()] == wanted
    assert listed == set(quality_rules.STOP_WORDS)


def test_quality_rules(spark, folder, rows):
    held_against(got(spark, "op6_quality_rules", folder), rows, lambda _, t: quality_of(t))


def test_byte_bpe(spark, folder, rows):
    import tiktoken

    path, pattern = byte_bpe.public_vocabulary()
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})

    def wanted(_, text):
        ids = reference.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    held_against(got(spark, "op2_byte_bpe", folder), rows, wanted)


def test_bpe_pieces_share_encodings(monkeypatch, tmp_path):
    """An encoding is made for thousands of new pieces, not for each; bounds change no id, and what a slice uses is kept."""
    import tiktoken

    path, pattern = byte_bpe.public_vocabulary()
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rng = random.Random(5)
    odd = ["", "\xff", "ÿ\xff ÿ", "\x00", "\n\n a\x1c \t", "漢字🙂" * 9, "y" * 3000]
    texts = odd + [" ".join("".join(rng.choice("abcdefghiéß漢🙂\xff'1") for _ in range(rng.randint(1, 9))) for _ in range(500)) for _ in range(12)]
    wanted = [reference.encode_ordinary(text) for text in texts]
    trips = [(len(ids), " ".join(map(str, ids)), text.encode()) for ids, text in zip(wanted, texts, strict=True)]

    class Counted:
        def __init__(self, library):
            self.library, self.made, self.pieces = library, 0, 0

        def encode_batch_fast(self, inputs, **how):
            self.made += len(inputs)
            self.pieces += sum(1 if isinstance(x, str) else len(x) for x in inputs)
            return self.library.encode_batch_fast(inputs, **how)

    own = byte_bpe.Codec(path, pattern)
    own.library = counted = Counted(own.library)
    assert own.encode(texts) == wanted
    assert counted.pieces > 4000 and counted.made <= 2
    assert list(own.round_trips(texts)) == trips
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 40)
    before = counted.pieces
    assert own.encode(texts[-1:]) == wanted[-1:] and counted.pieces == before
    monkeypatch.setattr(byte_bpe, "SENT_PIECES", 7)
    for _ in range(2):
        assert [ids for text in texts for ids in own.encode([text])] == wanted
        assert [trip for text in texts for trip in own.round_trips([text])] == trips

    (tmp_path / "few").write_text("YQ== 0\nYg== 1\nYWI= 2\n")
    few = byte_bpe.Codec(str(tmp_path / "few"), pattern)
    assert few.encode(["abba"]) == [[2, 1, 0]]
    with pytest.raises(ValueError, match="lacks a byte"):
        few.encode(["abc"])


def test_bpe_operators(spark):
    path, pattern = byte_bpe.public_vocabulary()
    df = spark.createDataFrame([(1, "Héllo 🙂 wörld"), (2, None), (3, "")], "doc_id int, text string")
    encoded = byte_bpe.bpe_encode(df, path, pattern)
    rows = {r.doc_id: r for r in encoded.collect()}
    codec = byte_bpe.codec(path, pattern)
    data = "Héllo 🙂 wörld".encode()
    for i, byte, char in zip(rows[1].ids, rows[1].byte_offsets, rows[1].char_offsets, strict=True):
        token = codec.token_bytes[i]
        assert data[byte : byte + len(token)] == token
        assert len(data[: byte + 1].decode("utf-8", "ignore")) - (1 if token[0] & 0xC0 != 0x80 and token[0] < 0x80 else 0) <= char + 1
    assert rows[2].ids == rows[3].ids == []
    assert {r.doc_id: r.text for r in byte_bpe.bpe_decode(encoded, path, pattern).collect()} == {1: "Héllo 🙂 wörld", 2: "", 3: ""}
    assert codec.decode(rows[1].ids[:3])
    part = codec.encode(["🙂"])[0][:1]
    assert codec.decode(part) == "�"


def lines_of(rows, least=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    ids = collections.defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            ids[key(line)].add(-(1 << 63) if doc_id is None else doc_id)

    def wanted(doc_id, text):
        lines = (text or "").split("\n")
        own = -(1 << 63) if doc_id is None else doc_id
        kept = [x for x in lines if len(key(x)) < 20 or len(ids[key(x)]) < least or max(ids[key(x)]) == own]
        return len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()

    return wanted


@pytest.mark.parametrize("heavy", [(10_000, 1000), (10_000, 3)])
def test_line_dedup(spark, folder, rows, heavy, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY_SHARE", heavy[0])
    monkeypatch.setattr(line_dedup, "HEAVY_LEAST", heavy[1])
    held_against(got(spark, "op7_line_dedup", folder), rows, lines_of(rows))


def test_drop_lines_carries_columns(spark, folder, rows):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    out = line_dedup.drop_lines(df)
    assert out.columns == df.columns
    kept = collections.Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect())
    assert kept == collections.Counter((r[0], lines_of(rows)(r[0], r[1])[2]) for r in rows)
    assert out.filter("doc_id IS NULL AND text IS NULL").count() == 1


def repeats(rows, length=400):
    data = [(r[0], np.frombuffer((r[1] or "").encode(), np.uint8).tobytes()) for r in rows]
    seen = collections.Counter(t[k : k + length] for _, t in data for k in range(len(t) - length + 1))

    def wanted(_, text):
        t = (text or "").encode()
        gone = np.zeros(len(t) + 1, dtype=int)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        covered = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        return len(t), int(covered.sum()), int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()

    return wanted


@pytest.mark.parametrize("bucket", [1 << 22, 1 << 12])
def test_suffix_dedup(spark, folder, rows, bucket, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    held_against(got(spark, "op3_suffix_dedup", folder), rows, repeats(rows))


def test_suffix_dedup_of_a_hot_passage(spark, written_documents, monkeypatch):
    """A passage of just enough bytes in many texts, cut by the splitters into several buckets."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 3000)
    rng = random.Random(1)
    junk = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [junk(399), junk(400), junk(401), junk(700)]
    rows = [(k, junk(rng.randint(0, 300)) + rng.choice(passages) + junk(rng.randint(0, 300))) for k in range(150)]
    folder = written_documents(rows)
    held_against({r.doc_id: [r] for r in suffix_dedup.query(spark, folder).collect()}, rows, repeats(rows))


def test_suffix_dedup_of_passages_like_those_of_the_check(spark, written_documents):
    """Passages of over 50 words in several documents, one of them in a third of all, over 211 partitions: what has 400 bytes
    goes wherever it stands, what has fewer stays."""
    rng = random.Random(12)
    syllables = "an er in on the ti ou re at en nd ha es st ed to it is or ea hi as te et ng of al le".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    passages = [say(rng.randint(51, 110)) for _ in range(12)]
    assert {len(p) < 400 for p in passages} == {True, False}
    rows = []
    for k in range(240):
        parts = [say(rng.randint(20, 60)) for _ in range(2)]
        if k % 3 == 0:
            parts.insert(1, passages[-1])
        elif k % 3 == 1:
            parts.insert(1, passages[k % 11])
        rows.append((k, "\n".join(parts)))
    folder = written_documents(rows, parts=40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        found = {r.doc_id: r for r in suffix_dedup.query(spark, folder).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    held_against({k: [r] for k, r in found.items()}, rows, repeats(rows))
    for k, text in rows:
        inside = [p for p in passages if p in text]
        if inside and len(inside[0]) >= 400:
            assert found[k].n_removed >= len(inside[0]), k
        else:
            assert found[k].n_removed == 0, k


def test_multikey_sort():
    from quirefold.llm.textkit import prefix_sums

    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data[1000:1200] = data[100:300]
    starts = np.arange(len(data) - 60)
    found, group = suffix_dedup.multikey_sort(prefix_sums(data), starts, 60, 16)
    seen = collections.defaultdict(list)
    for k in starts:
        seen[data[k : k + 60].tobytes()].append(int(k))
    wanted = sorted(sorted(v) for v in seen.values() if len(v) > 1)
    groups = collections.defaultdict(list)
    for f, g in zip(found.tolist(), group.tolist(), strict=True):
        groups[g].append(f)
    assert sorted(sorted(v) for v in groups.values()) == wanted


def shingles(text, words):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def component_of(rows, words=4, percent=85):
    """The number of the first row of each row's component."""
    sets = [shingles(r[1], words) for r in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(len(rows))]


def linked(rows, words=4, percent=85):
    label, least = component_of(rows, words, percent), {}
    for k, r in enumerate(rows):
        own = -(1 << 63) if r[0] is None else r[0]
        least[label[k]] = min(least.get(label[k], own), own)
    null = lambda x: None if x == -(1 << 63) else x
    return collections.Counter((r[0], len(shingles(r[1], words)), null(least[label[k]])) for k, r in enumerate(rows))


@pytest.mark.parametrize("unit", [1 << 21, 600])
def test_ngram_join(spark, folder, rows, unit, monkeypatch):
    monkeypatch.setattr(ngram_join.class_links, "__defaults__", (unit,))
    found = collections.Counter(tuple(r)[:3] for r in ngram_join.query(spark, folder).collect())
    assert found == linked(rows)


@pytest.mark.parametrize("unit", [1 << 21, 4000])
def test_ngram_join_of_near_copies(spark, written_documents, unit, monkeypatch):
    """A large group of near copies whose links are sparse, and chains that only connect over others."""
    monkeypatch.setattr(ngram_join.class_links, "__defaults__", (unit,))
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for k in range(120):  # of several sizes, so that the blocks differ
        cut = base[: rng.choice((45, 52, 60))]
        for _ in range(rng.randint(0, 3)):
            cut[rng.randrange(len(cut))] = rng.choice(words)
        rows.append((k, " ".join(cut)))
    chain = [rng.choice(words) for _ in range(80)]
    for k in range(30):
        rows.append((200 + k, " ".join(chain)))
        chain = [*chain[2:], rng.choice(words), rng.choice(words)]
    folder = written_documents(rows)
    found = collections.Counter(tuple(r)[:3] for r in ngram_join.query(spark, folder).collect())
    assert found == linked(rows)


def kept_by_hand(rows, words, percent):
    """How many rows of each (id, text) stay: one for a component, all without words."""
    from collections import Counter

    solid = [r for r in rows if WORD.search(r[1] or "")]
    groups = collections.defaultdict(list)
    for r, label in zip(solid, component_of(solid, words, percent), strict=True):
        groups[label].append(r)
    return len(groups) + len(rows) - len(solid), [Counter((r[0], r[1]) for r in g) for g in groups.values()]


def test_keep_one(spark, folder, rows):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    out = ngram_join.keep_one(df, 5, 80)
    assert out.columns == df.columns
    found = collections.Counter((r.doc_id, r.text) for r in out.collect())
    n, groups = kept_by_hand(rows, 5, 80)
    assert sum(found.values()) == n
    for g in groups:
        assert sum(found[k] for k in g) == 1
        low = lambda k: -(1 << 63) if k is None else k
        assert low(next(k for k in g if found[k])[0]) == min(low(k[0]) for k in g)


def test_keep_one_decides_by_row(spark):
    """Repeated rows of one id, copies without an id, and an id with two texts of which one is a copy."""
    words = [f"w{k}" for k in range(200)]
    a, b, c, d = (" ".join(words[k : k + 40]) for k in (0, 40, 80, 120))
    rows = [(1, a, 0), (1, a, 1), (1, a, 2), (None, b, 3), (None, b, 4), (7, b, 5), (5, c, 6), (6, c, 7), (6, d, 8), (None, None, 9), (None, None, 10), (9, "", 11), (9, "", 12)]
    out = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, id int"), 5, 80).collect()
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter([(1, a), (None, b), (5, c), (6, d), (None, None), (None, None), (9, ""), (9, "")])


def test_context_tree(spark, folder, rows):
    counts = collections.Counter()
    tokens = lambda t: [*WORD.findall((t or "").translate(LOW)), None]
    for doc_id, text, *_ in rows:
        if fold(doc_id, 7) != 2:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)

    def wanted(doc_id, text):
        own = tokens(text)
        return fold(doc_id, 7) == 2, len(own), sum(counts[t] > 0 for t in own), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 6)

    found = got(spark, "op10_context_tree", folder)
    for own in found.values():
        own[:] = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in own]
    held_against(found, rows, wanted)


def test_context_tree_is_a_distribution_and_exact():
    """Predictions sum to one, and equal the weighting computed sequence by sequence in the smallest case."""
    texts = [b"abracadabra abracadabra", b"abrakadabra", b""]
    tree = context_tree.Tree.choose(texts, depth=3, splits=64)
    data, at, _ = context_tree.streams(texts)
    cells, counts = np.unique(tree.leaf(data, at).astype(np.int64) * 256 + data[at], return_counts=True)
    log_p = tree.predictions(cells, counts).astype(float)
    assert np.allclose((10.0**log_p).sum(axis=1), 1, atol=1e-5)
    # a tree of the root alone is the estimator itself
    alone = context_tree.Tree(np.zeros((1, 256), dtype=np.int32), np.array([-1]), np.array([False]))
    only = alone.predictions(np.array([97, 98]), np.array([5, 1]))[0]
    kt = lambda a, b, bit: ((b if bit else a) + 0.5) / (a + b + 1)
    p = 1.0
    for bit, (a, b) in zip((0, 1, 1, 0, 0, 0, 0, 1), ((6, 0), (0, 6), (0, 6), (6, 0), (6, 0), (6, 0), (5, 1), (0, 5)), strict=True):
        p *= kt(a, b, bit)
    assert math.isclose(10.0 ** float(only[97]), p, rel_tol=1e-4)
    x = np.array([0.5, 1.0, 7.3, 1e6])
    assert np.allclose(context_tree.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-8)


def test_context_tree_is_the_tree_of_all_training_texts(spark, folder, rows):
    """Scores equal those of the tree in memory that splits whatever occurs twice."""
    texts = [(t or "").encode() for _, t, *_ in rows]
    learnt = [(t or "").encode() for k, t, *_ in rows if fold(k, 7) != 2]
    tree = context_tree.Tree.choose(learnt, depth=6, splits=1 << 40)
    coded = lambda some: (lambda data, at, which: (tree.leaf(data, at, 6).astype(np.int64) * 256 + data[at], which))(*context_tree.streams(some, 6))
    log_p = tree.predictions(*np.unique(coded(learnt)[0], return_counts=True)).reshape(-1)
    cells, which = coded(texts)
    wanted = collections.defaultdict(list)
    for (k, *_), score in zip(rows, np.bincount(which, weights=log_p[cells], minlength=len(texts)), strict=True):
        wanted[k].append(score)
    for k, own in got(spark, "op10_context_tree", folder).items():
        assert np.allclose(sorted(r.score for r in own), sorted(wanted[k]), rtol=1e-5, atol=1e-4), k


def test_context_tree_beats_its_base(spark, written_documents):
    """On held-out prose whose words follow each other the tree says more than counts of words do. (Of words drawn one by one
    counts are the best model there is.)"""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    after = [rng.choices(range(300), k=6) for _ in words]
    rows = []
    for k in range(600):
        at, text = rng.randrange(300), []
        for _ in range(150):
            text.append(words[at])
            at = rng.choice(after[at])
        rows.append((k, " ".join(text)))
    found = context_tree.query(spark, written_documents(rows)).filter("held_out").collect()
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    assert sum(r.score > r.base_score for r in found) > 0.9 * len(found)


def test_context_tree_learns_from_long_texts(spark, written_documents):
    """Contexts that only one long training text holds are split too."""
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh") for _ in range(200))
    learnt, held = ([k for k in range(2000) if (fold(k, 7) == 2) == is_held] for is_held in (False, True))
    rows = [(k, "".join(rng.choice("mnop ") for _ in range(300))) for k in learnt[1:60]] + [(learnt[0], passage * 400), (held[0], passage * 3)]
    found = {r.doc_id: r for r in context_tree.lm_score(spark.read.parquet(f"{written_documents(rows)}/documents.parquet")).collect()}
    assert found[held[0]].held_out
    assert found[held[0]].bits_per_byte < 0.5


class Captured:
    """Stands for a frame, and keeps the function that it is to be mapped by."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    def mapInArrow(self, function, _):
        self.function = function
        return self


def cells_dealt(spark, texts, shards=7):
    """The rows of cell_slices, and the most bytes held at once on the way beside the texts."""
    import tracemalloc

    frame = Captured(spark)
    context_tree.cell_slices(frame, shards)
    ids = np.arange(len(texts))
    whole = pa.table({"doc_id": ids, "text_key": ids, "text": texts, "held_out": ids % 7 == 2})
    tracemalloc.start()
    try:
        batches = [b.to_pydict() for b in frame.function(iter(whole.to_batches(max_chunksize=1000)))]
        return batches, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_context_tree_slices_stay_small(spark):
    """Bytes held at once by a worker that deals a slice of 16 MB; it was 36 for each byte. Texts whose cells are mostly
    distinct are cut into more slices."""
    rng = np.random.default_rng(5)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnop"), n)) for n in rng.integers(2, 9, 2000)])
    prose = [" ".join(rng.choice(words, 500)) for _ in range(6000)]
    batches, most = cells_dealt(spark, prose)
    assert sum(map(len, prose)) > 16_000_000 and len(batches) == 2
    assert most < 16 * 16_000_000
    noise = ["".join(map(chr, x)) for x in rng.integers(33, 127, (1800, 4000))]
    batches, most = cells_dealt(spark, noise)
    assert sum(len(x) for b in batches for x in b["ids"] if x) == len(noise) and len(batches) == 2
    assert most < 16 * 16_000_000


def test_context_tree_slices_hold_each_cell_once(spark):
    """Whatever is merged on the way, the shards' cells and counts are those of the texts."""
    rng = random.Random(17)
    texts = ["".join(rng.choice("abcAB é\n") for _ in range(rng.choice((0, 1, 5, 300_000)))) for _ in range(40)]
    (batch,), _ = cells_dealt(spark, texts)
    cells, which = context_tree.cells_of([t.encode() for t in texts])
    wanted = collections.Counter(cells.tolist())
    for cell, n in collections.Counter(cells[which % 7 == 2].tolist()).items():
        wanted[cell] -= n
    found = {}
    for shard, body, sizes in zip(batch["shard"], batch["body"], batch["sizes"], strict=True):
        if shard >= 0:
            own, counts = context_tree.unpacked(body, np.uint64), context_tree.unpacked(sizes, np.int64)
            assert (context_tree.shard_of(own, 7) == shard).all() and not found.keys() & set(own.tolist())
            found |= zip(own.tolist(), counts.tolist(), strict=True)
    assert found == wanted


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def longest_run(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0, *(row[j] + 1 if x == y else 0 for j, y in enumerate(b))]
        best = max(best, *row)
    return best


def test_alignment():
    rng = np.random.default_rng(3)
    items = [rng.integers(1, 6, rng.integers(1, 12)).astype(np.uint64) for _ in range(40)]
    passages = [rng.integers(1, 6, rng.integers(1, 25)).astype(np.uint64) for _ in range(40)]
    best, start, end, runs = decontaminate.align(items, passages)
    for k in range(40):
        wanted = smith_waterman(items[k].tolist(), passages[k].tolist())
        assert best[k] == wanted
        assert runs[k] == longest_run(items[k].tolist(), passages[k].tolist())
        if wanted:
            assert smith_waterman(items[k].tolist(), passages[k][start[k] : end[k] + 1].tolist()) == wanted


def test_decontaminate(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [say(40) for _ in range(20)]
    rows, wanted = [], set()
    for k in range(200):
        text = say(300)
        if k % 4 == 0:
            copy = list(items[k % 20])
            for _ in range((k // 4) % 9):
                copy[rng.randrange(40)] = rng.choice(words)
            if k % 8 == 0:
                del copy[10]
            text[100:100] = copy
            wanted.add((k, k % 20))
        rows.append((k, " ".join(text)))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(i).upper()) for k, i in enumerate(items)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = decontaminate.query(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id) for r in out} == wanted
    texts = dict(rows)
    exact = next(r for r in out if r.score == 1.0)
    assert texts[exact.doc_id].encode()[exact.start_byte : exact.end_byte].decode().split() == items[exact.item_id]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = decontaminate.keep_clean(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert {r.doc_id for r in clean.collect()} == {k for k, _ in rows} - {k for k, _ in wanted}


def edited(rng, item, share, words):
    """A copy of which a share of the words is replaced, dropped or has a word put before it."""
    out = []
    for word in item:
        kind = rng.random()
        out += [word] if kind >= share else [[rng.choice(words)], [], [rng.choice(words), word]][rng.randrange(3)]
    return out


def leaked(spark, tmp_path, texts, items):
    path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return {(r.doc_id, r.item_id): r for r in decontaminate.query(spark, path).collect()}


def test_decontaminate_edited_copies(spark, tmp_path):
    """Copies with a tenth to three tenths of their words edited, in prose with very frequent words, are found; prose without
    copies is left alone. THRESHOLD lies between what chance gives here and what these copies give."""
    rng = random.Random(8)
    common, rare = ["the", "of", "and", "to", "a", "in"], ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    say = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n)]
    items = [say(rng.randint(25, 70)) for _ in range(60)]
    texts, planted = [], {}
    for k in range(360):
        text = say(250)
        if k % 2:
            share = (0.1, 0.2, 0.3)[k % 3]
            planted[k, k % 60] = share
            text[80:80] = edited(rng, items[k % 60], share, rare)
        texts.append(text)
    found = leaked(spark, tmp_path, texts, items)
    assert not found.keys() - planted.keys()
    for share in (0.1, 0.2, 0.3):
        own = [key for key, of in planted.items() if of == share]
        assert sum(key in found for key in own) >= 0.95 * len(own), share


def test_decontaminate_against_whole_alignment(spark, tmp_path):
    """Scores, runs and pairs equal those of aligning every item with every whole text."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [say(rng.randint(3, 60)) for _ in range(12)]
    texts = []
    for k in range(48):
        text = say(rng.randint(0, 120))
        for _ in range(k % 3):
            at = rng.randint(0, len(text))
            text[at:at] = edited(rng, items[rng.randrange(12)], rng.choice((0, 0.1, 0.2)), words)
        texts.append(text)
    texts.append(items[3] * 30)  # seeds from one end to the other
    found = leaked(spark, tmp_path, texts, items)
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            score, run = smith_waterman(item, text) / (2 * len(item)) if text else 0, longest_run(item, text) if text else 0
            if (d, i) in found:
                assert found[d, i].score == score, (d, i)
                assert found[d, i].run == run, (d, i)
            else:
                assert score < 0.4 or longest_run(item, text) < 3, (d, i)  # below, or without any seed
                assert run < 16


def test_decontaminate_short_items_and_long_runs(spark, tmp_path):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    long = say(200)
    items = [["alpha", "beta"], ["gamma"], long, ["alpha"]]
    texts = [["alpha", "beta"], say(50) + ["ALPHA", "Beta"] + say(20), ["beta", "alpha"], say(20) + ["gamma"], say(100) + long[60:76] + say(100), say(100) + long[60:70] + say(100), []]
    found = leaked(spark, tmp_path, texts, items)
    assert found.keys() == {(0, 0), (1, 0), (3, 1), (4, 2), (0, 3), (1, 3), (2, 3)}
    assert found[1, 0].score == 1.0
    assert (found[4, 2].run, found[4, 2].score < 0.4) == (16, True)
    assert " ".join(texts[1])[found[1, 0].start_byte : found[1, 0].end_byte] == "ALPHA Beta"


def test_decontaminate_blocks(spark, folder, monkeypatch):
    whole = sorted(map(tuple, decontaminate.query(spark, folder).collect()), key=str)
    assert {r[:2] for r in whole} >= {(4, 0), (4, 5), (7, 1), (0, None), (1, None), (None, None)}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    monkeypatch.setattr(decontaminate, "PER_PASS", 2)
    assert sorted(map(tuple, decontaminate.query(spark, folder).collect()), key=str) == whole
    docs, items = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    gone = {r[0] for r in whole}
    kept = decontaminate.keep_clean(docs, items).collect()
    assert {r.doc_id for r in kept} - {None} == {r.doc_id for r in docs.collect()} - gone - {None}
    assert [r.text for r in kept if r.doc_id is None] == [None]  # the other row without an id holds an item


def test_language_and_quality_rows(spark, folder, rows):
    language = got(spark, "op4_language_id", folder)
    quality = got(spark, "op5_quality_classifier", folder)
    for doc_id, texts in texts_of(rows).items():
        assert len(language[doc_id]) == len(quality[doc_id]) == len(texts)
        for r in language[doc_id]:
            assert r.held_out == (fold(doc_id, 4) == 2)
            assert r.lang_pred in ("en", "fr", "und")
            assert 0 <= r.score <= 1
        for r in quality[doc_id]:
            assert r.held_out == (fold(doc_id, 5) == 0)
            assert 0 <= r.score <= 1
            assert r.predicted == int(r.score >= 0.3)
    assert all(r.lang_pred == "und" and r.score == 0 for r in language[60] + language[61] + language[62] + language[63])
