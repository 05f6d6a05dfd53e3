"""Line dedup by a sharded minimal perfect hash over distinct line hashes.

1. Each slice of documents becomes, for each shard of the hash space, one row: the distinct line hashes of the slice and
   the ids of the documents that hold them. Line text never leaves its document.
2. A shard gathers lines with at most min_docs ids of each slice (the largest: enough to tell the threshold and the
   largest id), and stores a minimal perfect hash of those that several documents hold, with compact arrays at its
   indices: 48-bit fingerprints, counts, the largest id. A fingerprint comes from a second, independent hash, so a line is
   known by 112 bits; lines that share a whole 64-bit hash are told apart.
3. The rows probe the arrays of their shard; what comes back is, for each document, the hashes it loses.
4. Documents meet their lists by id and drop those lines. That join is a merge join at every size, so texts are exchanged
   once, in proportion to the input.

Hot lines: a line that a 1/HEAVY_SHARE of all (document, line) pairs or more hold can be one of HEAVY_SHARE lines at
most. Those have a perfect hash and arrays of their own, which go to every worker and are probed there. So a line that a
third of all documents share costs its shard a few entries a slice. Every line, shard and document is handled; nothing is
capped.

Defined results: null or empty text is one empty line; a null id counts as an id below all others; repeated rows are one
document and lose the same lines; a tie is settled by the largest id; extra columns are carried by drop_lines and ignored
by the query; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import arrow_batches, dropped, pick, table, written
from quirefold.llm.perfect_hash import PerfectHash
from quirefold.llm.textkit import IS_SPACE, LOWER, U64, as_bytes, in_slices, lay, owner, prefix_sums, slices, span_hashes

MIN_CHARS = 20
MIN_DOCS = 3
LOWEST = -(1 << 63)
SLICE = 950_000
#: Hashes that go to every worker are HEAVY_SHARE at most, and each is held by HEAVY_LEAST documents at least.
HEAVY_SHARE = 10_000
HEAVY_LEAST = 1000


def line_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines of texts laid with \\n gaps, and of the stripped lines."""
    ends = np.flatnonzero(data == 0x0A)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    solid = np.flatnonzero(~IS_SPACE[data])
    first = np.searchsorted(solid, starts)
    last = np.searchsorted(solid, ends)
    some = last > first
    solid = np.concatenate((solid, [0]))
    return starts, ends, np.where(some, solid[first], starts), np.where(some, solid[last - 1] + 1, starts)


def line_keys(data: np.ndarray, prints: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, key hashes and fingerprints of the lines whose keys are long enough; and their place among all lines."""
    starts, _, left, right = line_spans(data)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    long = np.flatnonzero(chars[right] - chars[left] >= MIN_CHARS)
    low = LOWER[data]
    keys = span_hashes(prefix_sums(low), left[long], right[long])
    second = span_hashes(prefix_sums(low, 1), left[long], right[long], 1) if prints else np.zeros(0, U64)
    return starts[long], keys, second, long


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before it."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def lengths(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.concatenate((first, [n])))


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows, in order of the first column, then the next."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    new = changes(*columns)
    return tuple(c[new] for c in columns)


def hash_rows(docs: DataFrame, shards: int) -> DataFrame:
    """For each slice and shard: distinct lines (hash and fingerprint), how many ids hold each, those ids in order, and how
    many there are in all."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, limit=SLICE):
            data, starts, _ = lay(as_bytes(part.column("text")))
            at, keys, prints, _ = line_keys(data)
            keys, prints, ids = distinct(keys, prints, part.column("id").to_numpy(zero_copy_only=False)[owner(starts, at)])
            shard = shard_of(keys, shards)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]))
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    first = np.flatnonzero(changes(keys[a:b], prints[a:b]))
                    rows.append((int(shard[a]), keys[a:b][first].tobytes(), prints[a:b][first].tobytes(), lengths(first, b - a).astype(np.int32).tobytes(), ids[a:b].tobytes(), int(b - a)))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.binary()] * 4, pa.int64()), strict=True)], names=["shard", "hashes", "prints", "sizes", "ids", "pairs"])

    return docs.select("id", "text").mapInArrow(run, "shard bigint, hashes binary, prints binary, sizes binary, ids binary, pairs bigint")


_COLUMNS = ("hashes", "prints", "sizes", "ids")
_KINDS = (np.uint64, np.uint64, np.int32, np.int64)
_ROWS = "shard bigint, hashes binary, prints binary, sizes binary, ids binary"


def _unpacked(packed) -> tuple[np.ndarray, ...]:
    keys, prints, sizes, ids = (np.frombuffer(x, kind) for x, kind in zip(packed, _KINDS, strict=True))
    return keys, prints, sizes.astype(np.int64), ids


def _rows_out(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))], names=["shard", *_COLUMNS])


class LineIndex:
    """A minimal perfect hash over line hashes; at a hash's index 48 bits of the line's fingerprint, its count and largest
    id. Hash and fingerprint are independent, so a line is known by 112 bits. Lines that share all 64 bits of a hash have no
    place in a perfect hash and stand apart, in order, with whole fingerprints."""

    def __init__(self, found: PerfectHash, low: np.ndarray, high: np.ndarray, counts: np.ndarray, top: np.ndarray, apart: np.ndarray):
        self.found, self.low, self.high, self.counts, self.top, self.apart = found, low, high, counts, top, apart

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, top: np.ndarray) -> LineIndex:
        """keys and prints: distinct pairs, in order."""
        shared = ~changes(keys)
        shared[:-1] |= shared[1:]
        apart = np.stack([keys[shared], prints[shared], counts[shared].astype(U64), top[shared].view(U64)]) if shared.any() else np.zeros((4, 0), U64)
        keys, prints, counts, top = (x[~shared] for x in (keys, prints, counts, top))
        found = PerfectHash.build(keys)
        place = found.index(keys)
        columns = []
        for values, kind in ((prints & U64(0xFFFFFFFF), np.uint32), (prints >> U64(32) & U64(0xFFFF), np.uint16), (np.minimum(counts, 2**31 - 1), np.int32), (top, np.int64)):
            out = np.zeros(len(place), kind)
            out[place] = values.astype(kind)
            columns.append(out)
        return cls(found, *columns, apart)

    def dump(self) -> dict[str, bytes]:
        levels, words = self.found.dump()
        return {"levels": levels, "words": words, "low": self.low.tobytes(), "high": self.high.tobytes(), "counts": self.counts.tobytes(), "top": self.top.tobytes(), "apart": self.apart.tobytes()}

    @classmethod
    def load(cls, row) -> LineIndex:
        columns = (np.frombuffer(row[c], kind) for c, kind in (("low", np.uint32), ("high", np.uint16), ("counts", np.int32), ("top", np.int64)))
        return cls(PerfectHash.load(row["levels"], row["words"]), *columns, np.frombuffer(row["apart"], U64).reshape(4, -1))

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0: not known) and largest ids of lines."""
        counts, top = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        place = self.found.index(keys)
        some = np.flatnonzero(place >= 0)
        at = place[some]
        same = ((prints[some] & U64(0xFFFFFFFF)).astype(np.uint32) == self.low[at]) & ((prints[some] >> U64(32) & U64(0xFFFF)).astype(np.uint16) == self.high[at])
        counts[some[same]], top[some[same]] = self.counts[at[same]], self.top[at[same]]
        for key, mark, count, largest in self.apart.T:
            own = (keys == key) & (prints == mark)
            counts[own], top[own] = int(count), largest.view(np.int64)
        return counts, top


INDEX = "levels binary, words binary, low binary, high binary, counts binary, top binary, apart binary"


def build_index(rows: DataFrame, min_docs: int, heavy_at: int) -> DataFrame:
    """One row a shard: the index of the lines that two documents or more hold; and apart from these the heavy lines, with
    their counts and largest ids."""

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, *packed in zip(*(batch.column(c).to_pylist() for c in ("shard", *_COLUMNS)), strict=True):
                _, _, sizes, ids = _unpacked(packed)
                after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))  # 1 for the last id of a line
                out.append((shard, *packed[:3], ids[after <= min_docs].tobytes()))
            if out:
                yield _rows_out(out)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, prints, sizes, ids = _unpacked([b"".join(pdf[c]) for c in _COLUMNS])
        each = np.repeat(np.arange(len(keys)), np.minimum(sizes, min_docs))
        k, p, i = distinct(keys[each], prints[each], ids)
        first = np.flatnonzero(changes(k, p))
        names, marks, seen, top = k[first], p[first], lengths(first, len(k)), i[np.concatenate((first[1:], [len(k)])) - 1]
        order = np.lexsort((prints, keys))
        held = np.add.reduceat(sizes[order], np.flatnonzero(changes(keys[order], prints[order])))
        counts = np.where(seen >= min_docs, held, seen)  # repeated rows in several slices do not add up to the threshold
        heavy = (counts >= heavy_at) & (seen >= 2)
        build = (seen >= 2) & ~heavy
        index = LineIndex.build(names[build], marks[build], counts[build], top[build])
        return pd.DataFrame([{"shard": pdf["shard"].iloc[0], **index.dump(), "heavy": np.stack([names[heavy], marks[heavy], counts[heavy].astype(U64), top[heavy].view(U64)], axis=1).tobytes()}])

    return rows.select("shard", *_COLUMNS).mapInArrow(trim, _ROWS).groupBy("shard").applyInPandas(run, f"shard bigint, {INDEX}, heavy binary")


def probe(rows: DataFrame, index: DataFrame, min_docs: int, heavy: dict[str, bytes]) -> DataFrame:
    """id and hash of each line that a document loses, without the heavy lines."""

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LineIndex.load(heavy)
        for batch in batches:
            out = []
            for shard, *packed in zip(*(batch.column(c).to_pylist() for c in ("shard", *_COLUMNS)), strict=True):
                keys, prints, sizes, ids = _unpacked(packed)
                stays = known.probe(keys, prints)[0] == 0
                out.append((shard, keys[stays].tobytes(), prints[stays].tobytes(), sizes[stays].astype(np.int32).tobytes(), ids[np.repeat(stays, sizes)].tobytes()))
            if out:
                yield _rows_out(out)

    def run(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(asked) and len(shard):
            own = LineIndex.load(shard.iloc[0])
            for packed in zip(*(asked[c] for c in _COLUMNS), strict=True):
                keys, prints, sizes, ids = _unpacked(packed)
                counts, top = own.probe(keys, prints)
                known = counts >= min_docs
                ids, lost, best = ids[np.repeat(known, sizes)], np.repeat(keys[known], sizes[known]), np.repeat(top[known], sizes[known])
                out.append((ids[ids != best], lost[ids != best].view(np.int64)))
        return pd.DataFrame({"id": np.concatenate([x for x, _ in out]), "hash": np.concatenate([x for _, x in out])})

    asked = rows.select("shard", *_COLUMNS).mapInArrow(light, _ROWS)
    return asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(run, "id bigint, hash bigint")


def _id(column: Column) -> Column:
    return F.coalesce(column.cast("bigint"), F.lit(LOWEST))


def lost_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, dict[str, bytes]]:
    """id and the hashes of the lines that the documents of that id lose; the index of the heavy lines, which goes to every
    worker. docs: id, text."""
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = written(hash_rows(docs, shards))
    pairs = rows.agg(F.sum("pairs")).first()[0] or 0
    heavy_at = max(HEAVY_LEAST, min_docs, -(-pairs // HEAVY_SHARE))
    index = written(build_index(rows, min_docs, heavy_at))
    found = index.filter(F.octet_length("heavy") > 0).select("heavy").collect()  # HEAVY_SHARE entries at most
    entries = np.concatenate([np.zeros((0, 4), U64), *(np.frombuffer(r[0], U64).reshape(-1, 4) for r in found)])
    keys, prints, counts, top = entries[np.lexsort((entries[:, 1], entries[:, 0]))].T
    heavy = LineIndex.build(keys, prints, counts.astype(np.int64), np.ascontiguousarray(top).view(np.int64)).dump()
    lost = written(probe(rows, index, min_docs, heavy).groupBy("id").agg(F.collect_list("hash").alias("lost")))
    dropped(rows, index)
    return lost, heavy


def kept_lines(texts: list[bytes | None], ids: list[int], lost: list, heavy: LineIndex) -> list[tuple[bytes, int, int]]:
    """Of each text: what stays, its lines, and the lines dropped."""
    any_heavy = len(heavy.top) + heavy.apart.shape[1] > 0
    some = [k for k, x in enumerate(lost) if x or (any_heavy and texts[k])]
    gone: dict[int, np.ndarray] = {}
    if some:
        data, starts, _ = lay([texts[k] for k in some])
        at, keys, prints, place = line_keys(data, any_heavy)
        own = owner(starts, at)
        first_line = np.searchsorted(np.flatnonzero(data == 0x0A), starts)
        out = np.zeros(len(keys), dtype=bool)
        if any_heavy:
            counts, top = heavy.probe(keys, prints)
            out = (counts > 0) & (top != np.array([ids[k] for k in some], dtype=np.int64)[own])
        bounds = np.searchsorted(own, np.arange(len(some) + 1))
        for n, k in enumerate(some):
            a, b = bounds[n], bounds[n + 1]
            if lost[k] and b > a:
                out[a:b] |= np.isin(keys[a:b], np.array(lost[k], dtype=np.int64).view(np.uint64))
            if out[a:b].any():
                gone[k] = place[a:b][out[a:b]] - first_line[n]
    result = []
    for k, text in enumerate(texts):
        text = text or b""
        lines = text.count(b"\n") + 1
        if k in gone:
            stays = np.ones(lines, dtype=bool)
            stays[gone[k]] = False
            cut = text.split(b"\n")
            text = b"\n".join([cut[i] for i in np.flatnonzero(stays)])
        result.append((text, lines, len(gone.get(k, ()))))
    return result


def query(spark, sf_dir):
    docs = pick(table(spark, sf_dir, "documents"), doc_id="bigint", text="string").withColumn("id", _id(F.col("doc_id")))
    lost, heavy = lost_lines(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LineIndex.load(heavy)
        for part in in_slices(batches):
            got = kept_lines(as_bytes(part.column("text")), part.column("id").to_pylist(), part.column("lost").to_pylist(), known)
            columns = [part.column("doc_id"), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in got], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return docs.join(lost.hint("merge"), "id", "left").mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows, with all their columns, after their repeated lines are dropped from text. Null text stays null."""
    key, gone = "__line_dedup_id", "__line_dedup_lost"
    lost, heavy = lost_lines(docs.select(_id(F.col("doc_id")).alias("id"), F.col("text").cast("string").alias("text")), min_docs)
    lost = lost.withColumnsRenamed({"id": key, "lost": gone})

    @F.arrow_udf("string")
    def changed(texts: pa.Array, ids: pa.Array, lists: pa.Array) -> pa.Array:
        """The new text, or null where nothing goes: most texts do not come back from Python."""
        out: list[bytes | None] = []
        known = LineIndex.load(heavy)
        batch = pa.RecordBatch.from_arrays([texts, ids, lists], names=["text", "id", "lost"])
        for part in slices(batch) if len(texts) else ():
            got = kept_lines(as_bytes(part.column("text")), part.column("id").to_pylist(), part.column("lost").to_pylist(), known)
            out += [x[0] if x[2] else None for x in got]
        return pa.array(out, pa.binary()).cast(texts.type)

    joined = docs.withColumn(key, _id(F.col("doc_id"))).join(lost.hint("merge"), key, "left")
    return joined.withColumn("text", F.coalesce(changed(F.col("text").cast("string"), key, gone), F.col("text"))).select(*docs.columns)


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
n AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, n.key IS NOT NULL AND k.doc_id <> n.top AS gone FROM k LEFT JOIN n USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
