"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts anywhere else.

A suffix matters only as far as its first LENGTH bytes, its window. Windows are equal if and only if their suffixes are
neighbours that share LENGTH bytes in the sorted order of suffixes.

1. The leading token of a window is the least hash of the SEED-byte strings in it; equal windows have equal leading
   tokens. Runs of windows with one leading token are one record, so a text of n bytes has about n / 170 records, and a
   text that repeats itself has few. Slices send their leading tokens to shards of the hash space, and learn which
   occur more than once: only those records can hold a repeat.
2. These records, with the bytes of their windows, are range-partitioned by leading token with sampled splitters. A salt
   after the token lets the splitters cut a token that very many texts share.
3. A bucket sorts the suffixes of its records by multikey quicksort: by their first TOKEN bytes, then groups of equals by
   the next, and so on; groups that stay together over LENGTH bytes are repeats. (A key is the hash of its bytes: any
   order serves.)
4. Leading tokens at the ends of a bucket may go on in the next: their windows are compared across boundaries, once for
   each bucket that holds them.
5. The union of the repeated windows of a text is removed.

Matches never cross texts. Strings are judged on the input.

Defined results: null is empty text; texts shorter than LENGTH lose nothing; repeated rows are texts of their own, so
each is a repeat of the other; a null id counts as an id below all others and comes back null; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import arrow_batches, dropped, pick, table, written
from quirefold.llm.textkit import U64, as_bytes, in_slices, lay, owner, prefix_sums, span_hashes

LENGTH = 400
SEED = 64
TOKEN = 100
LOWEST = -(1 << 63)
SLICE = 950_000
BUCKET_BYTES = 3 << 19
SALTS = 1 << 16


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive values: least so far from both ends of blocks of that width."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def records(texts: list[bytes | None], length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leading token, text, first window and one past the last window of each record; and whether the token stands in it
    more than once, so that it may repeat itself."""
    data, starts, ends = lay(texts)
    sums = prefix_sums(data)
    at = np.arange(max(0, len(data) - seed + 1))
    seeds = span_hashes(sums, at, at + seed)
    least = sliding_min(seeds, length - seed + 1)
    which = owner(starts, np.arange(len(least)))
    inside = np.arange(len(least)) + length <= ends[which] if len(least) else np.zeros(0, dtype=bool)
    first = inside.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~inside[:-1] | (which[1:] != which[:-1])
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    text, tokens = which[a], least[a]
    again = np.fromiter((np.count_nonzero(seeds[x : y + length - seed] == t) > 1 for x, y, t in zip(a, b, tokens, strict=True)), dtype=bool, count=len(a))
    return tokens, text, a - starts[text], b - starts[text], again


_PIECE = "shard bigint, slice bigint, hashes binary, owners binary, ids array<bigint>, texts array<bigint>"


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _spans(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(values)) + 1, [len(values)]))
    return [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def leading_tokens(docs: DataFrame, shards: int, length: int, seed: int) -> DataFrame:
    """For each slice a row of its documents (shard -1) and, for each shard, the leading tokens of their records."""
    arrow_batches(docs.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["shard", "slice", "hashes", "owners", "ids", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, limit=SLICE):
            tokens, text, _, _, again = records(as_bytes(part.column("text")), length, seed)
            tokens, text = np.repeat(tokens, 1 + again), np.repeat(text, 1 + again)
            order = np.argsort(tokens, kind="stable")
            tokens, text = tokens[order], text[order].astype(np.uint32)
            name = uuid.uuid4().int >> 65
            rows = [(-1, name, None, None, part.column("id").to_pylist(), part.column("text_key").to_pylist())]
            rows += [(int(_shard(tokens[a : a + 1], shards)[0]), name, tokens[a:b].tobytes(), text[a:b].tobytes(), None, None) for a, b in _spans(_shard(tokens, shards))]
            yield _rows(rows, kinds, names)

    return docs.select("id", "text_key", "text").mapInArrow(run, _PIECE)


def repeated_tokens(pieces: DataFrame) -> DataFrame:
    """id, text_key and the leading tokens of a document that occur more than once."""

    def twice(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = np.frombuffer(b"".join(pdf["hashes"]), np.uint64)
        _, place, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        many = counts[place] > 1
        ends = np.cumsum([len(x) // 8 for x in pdf["hashes"]])
        rows = [(s, h[m].tobytes(), np.frombuffer(o, np.uint32)[m].tobytes()) for s, h, o, m in zip(pdf["slice"], np.split(tokens, ends[:-1]), pdf["owners"], np.split(many, ends[:-1]), strict=True) if m.any()]
        return pd.DataFrame(rows, columns=["slice", "hashes", "owners"])

    def by_document(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own) and len(parts):
            s = own.iloc[0]
            tokens, owners = np.frombuffer(b"".join(parts["hashes"]), np.uint64), np.frombuffer(b"".join(parts["owners"]), np.uint32)
            order = np.argsort(owners, kind="stable")
            tokens, owners = tokens[order], owners[order]
            rows = [(s["ids"][owners[a]], s["texts"][owners[a]], np.unique(tokens[a:b]).tobytes()) for a, b in _spans(owners.astype(np.int64))]
        return pd.DataFrame(rows, columns=["id", "text_key", "tokens"])

    answers = pieces.filter("shard >= 0").select("shard", "slice", "hashes", "owners").groupBy("shard").applyInPandas(twice, "slice bigint, hashes binary, owners binary")
    own = pieces.filter("shard < 0").select("slice", "ids", "texts")
    # repeated rows of one id and text have the same tokens
    return own.groupBy("slice").cogroup(answers.groupBy("slice")).applyInPandas(by_document, "id bigint, text_key bigint, tokens binary").groupBy("id", "text_key").agg(F.max("tokens").alias("tokens"))


def suffixes(docs: DataFrame, found: DataFrame, length: int, seed: int) -> DataFrame:
    """token, id, text_key, start and data: the records whose leading token occurs more than once."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["token", "id", "text_key", "start", "salt", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, limit=SLICE):
            texts, ids, keys = as_bytes(part.column("text")), part.column("id").to_pylist(), part.column("text_key").to_pylist()
            known = [np.frombuffer(t, np.uint64) for t in part.column("tokens").to_pylist()]
            tokens, text, a, b, _ = records(texts, length, seed)
            rows = []
            for x, y in _spans(text):
                k = text[x]
                for r in np.flatnonzero(np.isin(tokens[x:y], known[k])) + x:
                    rows.append((int(tokens[r : r + 1].view(np.int64)[0]), ids[k], keys[k], int(a[r]), (ids[k] * 7919 + int(a[r])) % SALTS, texts[k][a[r] : b[r] + length - 1]))
            yield _rows(rows, kinds, names)

    return docs.join(found.hint("merge"), ["id", "text_key"]).select("id", "text_key", "text", "tokens").mapInArrow(run, "token bigint, id bigint, text_key bigint, start bigint, salt int, data binary")


def multikey_sort(sums: np.ndarray, starts: np.ndarray, length: int, token: int = TOKEN) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the suffixes that share their first length bytes with another, and the number of their group."""
    left = np.arange(len(starts), dtype=np.int32)
    group = np.zeros(len(starts), dtype=np.int32)
    for depth in range(0, length, token):
        at = starts[left] + depth
        key = span_hashes(sums, at, at + min(token, length - depth))
        order = np.lexsort((key, group)) if depth else np.argsort(key)
        key, group, left = key[order], group[order], left[order]
        new = np.ones(len(left), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        alone = new.copy()
        alone[:-1] &= new[1:]
        group = np.cumsum(new, dtype=np.int32)[~alone]
        left = left[~alone]
        if not len(left):
            break
    return left, group


_BUCKET = "kind int, shard bigint, bucket bigint, ids binary, texts binary, starts binary, ends binary, keys binary"
_BUCKET_KINDS = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
_BUCKET_NAMES = ["kind", "shard", "bucket", "ids", "texts", "starts", "ends", "keys"]


def sorted_buckets(rows: DataFrame, buckets: int, shards: int, length: int) -> DataFrame:
    """Of each bucket: spans of repeated windows (kind 0); and for its first and last leading tokens, shard by shard, the
    windows (kind 1: those not yet found repeated; kind 2: only keys, of those that were)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]  # a bucket is bounded by the splitters
        if not held:
            return
        whole = pa.Table.from_batches(held)
        token = whole.column("token").to_numpy()
        ids, texts, begin = (whole.column(c).to_numpy() for c in ("id", "text_key", "start"))
        data = [x for chunk in whole.column("data").chunks for x in as_bytes(chunk)]
        buffer = np.frombuffer(b"".join(data), dtype=np.uint8)
        sizes = np.array([len(x) for x in data], dtype=np.int64)
        offsets = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        record = np.repeat(np.arange(len(data), dtype=np.int32), windows)
        inner = np.arange(windows.sum(), dtype=np.int32) - np.repeat((np.cumsum(windows) - windows).astype(np.int32), windows)
        starts = offsets[record] + inner
        sums = prefix_sums(buffer)
        found, group = multikey_sort(sums, starts, length)
        name = uuid.uuid4().int >> 65
        yield _spans_row(name, record[found], inner[found], ids, texts, begin, length)
        edge = (token == token.min()) | (token == token.max())
        closed = np.zeros(len(starts), dtype=bool)
        closed[found] = True
        heads = found[np.flatnonzero(np.diff(group, prepend=-1))] if len(found) else found
        for kind, some in ((1, np.flatnonzero(edge[record] & ~closed)), (2, heads[edge[record[heads]]])):
            key = span_hashes(sums, starts[some], starts[some] + length)
            order = np.argsort(key)
            some, key = some[order], key[order]
            shard = _shard(key, shards)
            out = []
            for a, b in _spans(shard):
                r = record[some[a:b]]
                if kind == 1:
                    out.append((1, int(shard[a]), name, ids[r].tobytes(), texts[r].tobytes(), (begin[r] + inner[some[a:b]]).tobytes(), None, key[a:b].tobytes()))
                else:
                    out.append((2, int(shard[a]), name, None, None, None, None, key[a:b].tobytes()))
            if out:
                yield _rows(out, _BUCKET_KINDS, _BUCKET_NAMES)

    def _spans_row(name, record, inner, ids, texts, begin, length):
        order = np.lexsort((inner, record))
        record, inner = record[order], inner[order]
        cut = np.ones(len(record), dtype=bool)
        cut[1:] = (record[1:] != record[:-1]) | (inner[1:] - inner[:-1] > length)
        a = np.flatnonzero(cut)
        z = np.concatenate((a[1:], [len(record)])) - 1 if len(a) else a
        r = record[a]
        return _rows([(0, -1, name, ids[r].tobytes(), texts[r].tobytes(), (begin[r] + inner[a]).tobytes(), (begin[r] + inner[z] + length).tobytes(), None)], _BUCKET_KINDS, _BUCKET_NAMES)

    return rows.repartitionByRange(buckets, "token", "salt").mapInArrow(run, _BUCKET)


_SPANS = "id bigint, text_key bigint, a bigint, b bigint"


def across_boundaries(rows: DataFrame, length: int) -> DataFrame:
    """Spans of the windows that several buckets hold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(pdf["keys"]), np.uint64)
        counts = [len(k) // 8 for k in pdf["keys"]]
        bucket = np.repeat(np.unique(pdf["bucket"].to_numpy(), return_inverse=True)[1], counts)
        order = np.lexsort((bucket, keys))
        k, h = keys[order], bucket[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        last = np.concatenate((np.flatnonzero(new)[1:], [len(k)]))[np.cumsum(new) - 1] - 1
        several = np.empty(len(k), dtype=bool)
        several[order] = h[last] != h[first]
        out = []
        for kind, ids, texts, starts, own in zip(pdf["kind"], pdf["ids"], pdf["texts"], pdf["starts"], np.split(several, np.cumsum(counts)[:-1]), strict=True):
            if kind == 1 and own.any():
                x = pd.DataFrame({"id": np.frombuffer(ids, np.int64)[own], "text_key": np.frombuffer(texts, np.int64)[own], "a": np.frombuffer(starts, np.int64)[own]})
                x = x.sort_values(["id", "text_key", "a"])
                run_ = ((x[["id", "text_key"]] != x[["id", "text_key"]].shift()).any(axis=1) | (x["a"].diff() > length)).cumsum()
                x = x.groupby(run_).agg(id=("id", "first"), text_key=("text_key", "first"), a=("a", "min"), b=("a", "max"))
                x["b"] += length
                out.append(x)
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "text_key", "a", "b")})

    return rows.groupBy("shard").applyInPandas(run, _SPANS)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in ("ids", "texts", "starts", "ends")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "text_key", "a", "b"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """id, text_key and the spans that a document loses. docs: id, text_key, text."""
    spark = docs.sparkSession
    docs = docs.filter(F.octet_length("text") >= length)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    pieces = written(leading_tokens(docs, shards, length, seed))
    found = written(repeated_tokens(pieces))
    dropped(pieces)
    tokens = found.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    buckets = max(shards, -(-tokens // 8 * (length + 170) // BUCKET_BYTES))
    rows = written(sorted_buckets(suffixes(docs, found, length, seed), buckets, shards, length))
    dropped(found)
    near = rows.filter("kind = 0").select("ids", "texts", "starts", "ends").mapInArrow(_unpack, _SPANS)
    far = across_boundaries(rows.filter("kind > 0"), length)
    spans = written(near.union(far).groupBy("id", "text_key").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    dropped(rows)
    return spans


def without(text: bytes, spans: list) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes went, and in how many maximal runs."""
    kept, gone, runs, at = [], 0, 0, 0
    last = -1
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if a > last:
            runs += 1
            kept.append(text[at:a])
            gone += b - a
            at = last = b
        elif b > last:
            gone += b - last
            at = last = b
    kept.append(text[at:])
    return b"".join(kept), gone, runs


def query(spark, sf_dir):
    docs = pick(table(spark, sf_dir, "documents"), doc_id="bigint", text="string").withColumns({"id": F.coalesce("doc_id", F.lit(LOWEST)), "text_key": F.xxhash64(F.coalesce("text", F.lit("")))})
    spans = repeated_spans(docs.select("id", "text_key", "text"))
    arrow_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches):
            got = [(len(t or b""), *without(t or b"", s or [])) for t, s in zip(as_bytes(part.column("text")), part.column("spans").to_pylist(), strict=True)]
            columns = [part.column("doc_id"), *(pa.array([x[k] for x in got], pa.int64()) for k in (0, 2, 3)), pa.array([hashlib.sha256(x[1]).hexdigest() for x in got], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.join(spans.hint("merge"), ["id", "text_key"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
