"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document is its set of distinct word-shingle hashes. Documents with equal sets are one class; links are searched
between classes, and two sets link when PERCENT of their union is shared.

1. Gate. In any common order of shingles, two linked sets of sizes n and n' share at least min(m, m') + 1 of their first
   2m + 1 shingles, where m = floor((1 - t) n). Each slice sends each shard of the hash space the first shingles (by hash)
   of its sets, 32 bits each; a shard says which of them another set has as well. A class without enough of them has no
   link and is done. What the 32 bits merge by chance only lets more classes through.
2. The whole sets of the classes that are left are counted the same way, exactly; a class that shares fewer than its
   threshold T = ceil(t n) of shingles has no link. The others get the prefix of their n - T + 1 rarest shingles:
   linked sets share one of these. Classes that share a prefix shingle form candidate groups (connected components).
3. The sets of a group are put in order of size and cut into blocks of a bounded number of shingles (most groups are one
   block). A block is searched in one task: inverted lists over its sets, and for each set as the query the T-occurrence
   problem by DivideSkip: the longest lists are set apart, the short ones are merged by a heap, what occurs often enough
   there is probed in the long ones by binary search, and sets that reach the overlap are linked.
4. Where a group has several blocks, its sets are cut a second time, half a block further on and dealt anew within equal
   sizes, and searched again: sets of like size meet, and nearly all of a group of near copies is connected. The sets
   outside the group's largest component are then searched against each block whose sizes can link with theirs. Every
   pair of sets that can link and is not already connected is searched, so components are exact.

The result is the component of each document, with its smallest doc_id. Nothing is sampled or capped. Work is in
proportion to the shingles of a group, but for the sets outside its largest component: those cost the blocks of their own
sizes each. A group that falls into many components of like size therefore costs the square of its blocks.

Defined results: a text without words (or null) has an empty set and is alone; fewer words than a shingle are one shingle
of all of them; a null id counts as an id below all others and comes back null; repeated rows are copies, and keep_one
keeps one of them; where one id has several texts each is judged apart; of rows with the same smallest id the one whose
text has the smaller hash stays; rows with an empty set all stay; extra columns are carried by keep_one and ignored by
the query; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.llm.common import arrow_batches, dropped, pick, table, written
from quirefold.llm.components import components
from quirefold.llm.textkit import LOWER, U64, as_bytes, gram_hashes, in_slices, lay, mix, prefix_sums, span_hashes, words_of

WORDS = 4
PERCENT = 85
LOWEST = -(1 << 63)
SLICE = 950_000
#: Shingles of a block.
UNIT = 1 << 21
MU = 0.0085  # weight of a probe against a merge step, in the rule for how many lists are long
TOGETHER = 32  # candidates that are probed at once


def sets_of(texts: list[bytes | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending; where each text's begin; its class key (0: empty)."""
    data, starts, ends = lay(texts)
    data = LOWER[data]
    left, right = words_of(data)
    hashes = span_hashes(prefix_sums(data), left, right)
    bounds = np.searchsorted(left, np.concatenate((starts, [len(data)])))
    counts = np.diff(bounds)
    which = np.repeat(np.arange(len(texts)), counts)
    grams = gram_hashes(hashes, words)
    whole = which[: len(grams)] == which[words - 1 :] if len(grams) else np.zeros(0, dtype=bool)
    grams, owners = grams[whole], which[: len(grams)][whole]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        few = np.array([gram_hashes(hashes[bounds[k] : bounds[k + 1]], int(counts[k]))[0] for k in short], dtype=np.uint64)
        grams, owners = np.concatenate((grams, few)), np.concatenate((owners, short))
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    grams, owners = grams[new], owners[new]
    first = np.searchsorted(owners, np.arange(len(texts) + 1))
    n = np.diff(first)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams))))
    keys = mix((sums[first[1:]] - sums[first[:-1]]) ^ (n.astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
    keys[(n > 0) & (keys == 0)] = 1
    keys[n == 0] = 0
    return grams, first, keys


def slack(n, percent: int):
    """How many shingles of a set of n may be missing in a linked set."""
    return n * (100 - percent) // 100


def _shards(spark, df: DataFrame) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def _spans(shard: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
    return [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_PIECE = [("shard", pa.int64()), ("slice", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
_PIECE_SQL = "shard bigint, slice bigint, hashes binary, owners binary, ids array<bigint>, texts array<bigint>, keys array<bigint>, sizes array<bigint>"


def first_shingles(docs: DataFrame, shards: int, percent: int, words: int) -> DataFrame:
    """docs: id, text_key, text. For each slice one row of its documents (shard -1) and, for each shard, one of the first
    shingles of its distinct sets."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, limit=SLICE):
            grams, first, keys = sets_of(as_bytes(part.column("text")), words)
            n = np.diff(first)
            one = np.zeros(len(n), dtype=bool)
            one[np.unique(keys, return_index=True)[1]] = True
            take = np.where(one & (n > 0), np.minimum(n, 2 * slack(n, percent) + 1), 0)
            owners = np.repeat(np.arange(len(n)), take)
            at = np.repeat(first[:-1], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            hashes = grams[at]
            order = np.argsort(hashes, kind="stable")
            hashes, owners = hashes[order], owners[order].astype(np.uint32)
            shard = _shard(hashes, shards)
            # the 32 bits after those that choose the shard
            low = ((hashes >> U64(32)) * U64(shards) & U64(0xFFFFFFFF)).astype(np.uint32) ^ (hashes & U64(0xFFFFFFFF)).astype(np.uint32)
            name = uuid.uuid4().int >> 65
            rows = [(-1, name, None, None, part.column("id").to_pylist(), part.column("text_key").to_pylist(), keys.view(np.int64).tolist(), n.tolist())]
            rows += [(int(shard[a]), name, low[a:b].tobytes(), owners[a:b].tobytes(), None, None, None, None) for a, b in _spans(shard)]
            yield _batch(rows, _PIECE)

    return docs.select("id", "text_key", "text").mapInArrow(run, _PIECE_SQL)


def gate(pieces: DataFrame, percent: int) -> DataFrame:
    """Keys of the classes that may have a link."""

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = np.frombuffer(b"".join(pdf["hashes"]), np.uint32)
        _, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        twice = counts[place] >= 2
        ends = np.cumsum([len(x) // 4 for x in pdf["hashes"]])
        rows = []
        for name, owners, own in zip(pdf["slice"], pdf["owners"], np.split(twice, ends[:-1]), strict=True):
            sets, times = np.unique(np.frombuffer(owners, np.uint32)[own], return_counts=True)
            if len(sets):
                rows.append((name, sets.astype(np.uint32).tobytes(), times.astype(np.uint32).tobytes()))
        return pd.DataFrame(rows, columns=["slice", "sets", "times"])

    def passed(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, s in own.iterrows():
            n = np.array(s["sizes"], dtype=np.int64)
            count = np.zeros(len(n), dtype=np.int64)
            if len(parts):
                np.add.at(count, np.frombuffer(b"".join(parts["sets"]), np.uint32), np.frombuffer(b"".join(parts["times"]), np.uint32))
            least = -(-n * percent // 100)  # smallest size of a linked set
            keep = (n > 0) & (count >= np.minimum(slack(n, percent), slack(least, percent)) + 1)
            out.append(pd.DataFrame({"key": np.array(s["keys"], dtype=np.int64)[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"key": np.zeros(0, np.int64)})

    answers = pieces.filter("shard >= 0").select("shard", "slice", "hashes", "owners").groupBy("shard").applyInPandas(shared, "slice bigint, sets binary, times binary")
    rows = pieces.filter("shard < 0").select("slice", "keys", "sizes")
    return rows.groupBy("slice").cogroup(answers.groupBy("slice")).applyInPandas(passed, "key bigint").distinct()


_SETS = [("slice", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary())]


def whole_sets(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """One row a slice: keys, sizes and hashes of the sets of the chosen documents (id, text_key)."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, limit=SLICE):
            grams, first, keys = sets_of(as_bytes(part.column("text")), words)
            yield _batch([(uuid.uuid4().int >> 65, keys.tobytes(), np.diff(first).tobytes(), grams.tobytes())], _SETS)

    return docs.join(chosen.hint("merge"), ["id", "text_key"], "left_semi").select("text").mapInArrow(run, "slice bigint, keys binary, sizes binary, hashes binary")


def rare_prefixes(slices: DataFrame, shards: int, percent: int) -> DataFrame:
    """key, n, hashes and prefix of the sets that share enough shingles with others to have a link."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, hashes in zip(batch.column("slice").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                hashes = np.sort(np.frombuffer(hashes, np.uint64))
                shard = _shard(hashes, shards)
                yield _batch([(int(shard[a]), name, hashes[a:b].tobytes()) for a, b in _spans(shard)], [("shard", pa.int64()), ("slice", pa.int64()), ("hashes", pa.binary())])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        _, place, counts = np.unique(np.frombuffer(b"".join(pdf["hashes"]), np.uint64), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(x) // 8 for x in pdf["hashes"]])
        back = [np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in np.split(counts[place], ends[:-1])]
        return pd.DataFrame({"slice": pdf["slice"], "shard": pdf["shard"], "counts": back})

    def choose(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, s in own.iterrows():
            keys, sizes, hashes = np.frombuffer(s["keys"], np.int64), np.frombuffer(s["sizes"], np.int64), np.frombuffer(s["hashes"], np.uint64)
            seen = np.empty(len(hashes), dtype=np.int64)
            if len(hashes):
                seen[np.argsort(hashes, kind="stable")] = np.frombuffer(b"".join(parts.sort_values("shard")["counts"]), np.uint32)
            ends = np.cumsum(sizes)
            for key, n, end in zip(keys, sizes, ends, strict=True):
                own_hashes, own_seen = hashes[end - n : end], seen[end - n : end]
                if n and (own_seen >= 2).sum() >= n - slack(n, percent):
                    rare = np.lexsort((own_hashes, own_seen))[: slack(n, percent) + 1]
                    rare = rare[own_seen[rare] >= 2]
                    if len(rare):
                        rows.append((key, n, own_hashes.tobytes(), own_hashes[rare].view(np.int64).tolist()))
        return pd.DataFrame(rows, columns=["key", "n", "hashes", "prefix"])

    dealt = slices.select("slice", "hashes").mapInArrow(deal, "shard bigint, slice bigint, hashes binary")
    counts = dealt.groupBy("shard").applyInPandas(count, "slice bigint, shard bigint, counts binary")
    return slices.groupBy("slice").cogroup(counts.groupBy("slice")).applyInPandas(choose, "key bigint, n bigint, hashes binary, prefix array<bigint>")


def merge_counts(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries that stand in at least so many of the ascending lists, and how many lists hold each."""
    found, counts = [], []
    for x, equal in groupby(heapq.merge(*(entries.tolist() for entries in lists))):
        n = sum(1 for _ in equal)
        if n >= least:
            found.append(x)
            counts.append(n)
    return np.array(found, dtype=np.int64), np.array(counts, dtype=np.int64)


class Inverted:
    """Inverted lists over sets, and T-occurrence search by DivideSkip for each set among those before it."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owners = np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(hashes, kind="stable")  # owners ascend within a hash
        self.entries = owners[order]
        start = np.ones(len(order), dtype=bool)
        start[1:] = hashes[order][1:] != hashes[order][:-1]
        begin = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.low, self.high = begin[place], place  # of each shingle of each set: its list, up to the set itself
        self.first = np.concatenate(([0], np.cumsum(self.n)))

    def contains(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """In how many of the lists each x stands, by binary search for all of them in all lists at once."""
        a, b = (np.repeat(ends[None, :], len(x), axis=0) for ends in (low, high))
        x = x[:, None]
        while True:
            open_ = a < b
            if not open_.any():
                break
            mid = (a + b) >> 1
            less = open_ & (self.entries[np.minimum(mid, len(self.entries) - 1)] < x)
            a = np.where(less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        return ((a < high) & (self.entries[np.minimum(a, len(self.entries) - 1)] == x)).sum(axis=1)

    def search(self, q: int, skip) -> Iterator[int]:
        """Earlier sets that link with set q. skip(y) is asked before each probe."""
        low, high = self.low[self.first[q] : self.first[q + 1]], self.high[self.first[q] : self.first[q + 1]]
        length = high - low
        some = length > 0
        n = int(self.n[q])
        need = n - slack(n, self.percent)
        if int(some.sum()) < need:
            return
        low, high, length = low[some], high[some], length[some]
        order = np.argsort(length, kind="stable")
        low, high, length = low[order], high[order], length[order]
        long = min(need - 1, int(need / (MU * math.log2(max(2, int(length[-1]))) + 1)))
        cut = len(length) - long
        found, counts = merge_counts([self.entries[a:b] for a, b in zip(low[:cut], high[:cut], strict=True)], max(1, need - long))
        overlap = -(-self.percent * (n + self.n[found]) // (100 + self.percent))
        able = np.flatnonzero(counts + long >= overlap)
        able = able[np.argsort(-counts[able], kind="stable")]
        wanted = (k for k in able.tolist() if not skip(int(found[k])))
        while some := list(islice(wanted, TOGETHER)):
            held = counts[some] + self.contains(low[cut:], high[cut:], found[some])
            for k, enough in zip(some, held >= overlap[some], strict=True):
                if enough and not skip(int(found[k])):
                    yield int(found[k])


def search_unit(keys: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets of a unit; sets with equal labels are connected already."""
    keys, place = np.unique(keys, return_index=True)  # repeated rows
    sets, labels = [sets[k] for k in place], labels[place]
    order = np.argsort([len(s) for s in sets], kind="stable")
    keys, sets, labels = keys[order], [sets[k] for k in order], labels[order]
    root = np.unique(labels, return_inverse=True)[1].tolist()
    up = list(range(max(root, default=-1) + 1))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    lists, links = Inverted(sets, percent), []
    for q in range(len(sets)):
        for y in lists.search(q, lambda y, q=q: top(root[y]) == top(root[q])):
            up[max(top(root[y]), top(root[q]))] = min(top(root[y]), top(root[q]))
            links.append((int(keys[q]), int(keys[y])))
    return links


def _units(df: DataFrame, unit: list[str], percent: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links = search_unit(pdf["key"].to_numpy(), [np.frombuffer(h, np.uint64) for h in pdf["hashes"]], pdf["label"].to_numpy(), percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return df.select(*unit, "key", "hashes", "label").groupBy(*unit).applyInPandas(run, "a bigint, b bigint")


def _in_blocks(sets: DataFrame, unit: int, name: str, turn: int = 0) -> DataFrame:
    """sets (g, key, n, ...) with their block: those of a group in order of size, about unit shingles to a block. Sets of one
    size are spread over its stretch by a hash, so only sizes are sorted, not sets. turn 1 moves the cuts by half a block."""
    sizes = sets.groupBy("g", "n").agg(F.sum("n").alias("w"))
    before = F.sum("w").over(W.partitionBy("g").orderBy("n").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("g", "n", "w", F.coalesce(before, F.lit(0).cast("bigint")).alias("before"))
    spread = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(1 << 20)) / F.lit(1 << 20)
    block = F.floor((F.col("before") + spread * F.col("w") + F.lit(turn * unit // 2)) / F.lit(unit))
    return sets.join(sizes, ["g", "n"]).withColumn(name, block).drop("w", "before")


def class_links(sets: DataFrame, percent: int, unit: int = UNIT) -> list[DataFrame]:
    """Written tables of links between classes (a, b) that together connect all that is linked. sets: key, n, hashes, prefix."""
    posting = sets.select("key", F.explode("prefix").alias("h"))
    hubs = posting.groupBy("h").agg(F.min("key").alias("hub"), F.max("key").alias("other")).filter("hub <> other")
    groups = components(posting.join(hubs, "h").select(F.col("key").alias("a"), F.col("hub").alias("b")))
    own = sets.select("key", "n", "hashes").join(groups, F.col("key") == F.col("v")).select("key", "n", "hashes", F.col("label").alias("g"))
    members = written(_in_blocks(own, unit, "c").withColumn("label", F.col("key")))
    dropped(groups)
    parts = [written(_units(members, ["g", "c"], percent))]
    several = members.groupBy("g").agg(F.max("c").alias("last")).filter("last > 0").select("g")
    if several.limit(1).count():
        large = members.join(several, "g")
        parts.append(written(_units(_in_blocks(large.drop("c"), unit, "c", turn=1), ["g", "c"], percent)))
        known = components(parts[0].union(parts[1]))
        labelled = large.drop("label").join(known, F.col("key") == F.col("v"), "left").select("g", "c", "key", "n", "hashes", F.coalesce("label", "key").alias("label"))
        labelled = written(labelled)
        dropped(known)
        largest = labelled.groupBy("g", "label").agg(F.sum("n").alias("w")).groupBy("g").agg(F.max_by("label", F.struct("w", "label")).alias("main"))
        rest = written(_in_blocks(labelled.drop("c").join(largest, "g").filter("label <> main").drop("main"), unit, "t"))
        reach = lambda df, block, a, b: df.groupBy("g", block).agg(F.min("n").alias(a), F.max("n").alias(b))
        met = reach(labelled, "c", "c_least", "c_most").join(reach(rest, "t", "t_least", "t_most"), "g")
        met = met.filter((F.lit(100) * F.col("c_most") >= F.lit(percent) * F.col("t_least")) & (F.lit(100) * F.col("t_most") >= F.lit(percent) * F.col("c_least"))).select("g", "c", "t")
        columns = ["g", "c", "t", "key", "hashes", "label"]
        pairs = labelled.join(met, ["g", "c"]).select(columns).union(rest.join(met, ["g", "t"]).select(columns))
        parts.append(written(_units(pairs, ["g", "c", "t"], percent)))
        dropped(labelled, rest)
    dropped(members)
    return parts


def grouped(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A written table with a row for each row of docs (id, text): id, text_key, n (shingles), component (the smallest id)
    and of (the text_key of the row that stands for the component)."""
    spark = docs.sparkSession
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    shards = _shards(spark, docs)
    pieces = written(first_shingles(docs, shards, percent, words))
    rows = written(pieces.filter("shard < 0").select(F.explode(F.arrays_zip("ids", "texts", "keys", "sizes")).alias("r")).select(F.col("r.ids").alias("id"), F.col("r.texts").alias("text_key"), F.col("r.keys").alias("key"), F.col("r.sizes").alias("n")))
    classes = written(rows.filter("n > 0").groupBy("key").agg(F.min(F.struct("id", "text_key")).alias("r"), F.max("n").alias("n")).select("key", "n", F.col("r.id").alias("id"), F.col("r.text_key").alias("text_key")))
    chosen = classes.join(gate(pieces, percent), "key", "left_semi").select("id", "text_key")
    slices = written(whole_sets(docs, chosen, words))
    dropped(pieces)
    sets = written(rare_prefixes(slices, shards, percent))
    dropped(slices)
    links = class_links(sets, percent)
    dropped(sets)
    label = components(reduce(DataFrame.union, links))
    dropped(*links)
    named = classes.join(label, F.col("key") == F.col("v"), "left").withColumn("label", F.coalesce("label", "key"))
    least = named.groupBy("label").agg(F.min(F.struct("id", "text_key")).alias("r"))
    named = named.join(least, "label").select("key", F.col("r.id").alias("component"), F.col("r.text_key").alias("of"))
    out = written(rows.join(named, "key", "left").select("id", "text_key", "n", F.coalesce("component", "id").alias("component"), F.coalesce("of", "text_key").alias("of")))
    dropped(rows, classes, label)
    return out


def _ids(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="bigint", text="string").select(F.coalesce("doc_id", F.lit(LOWEST)).alias("id"), "text")


def query(spark, sf_dir):
    out = grouped(_ids(table(spark, sf_dir, "documents")))
    null = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return out.select(null("id").alias("doc_id"), F.col("n").alias("n_shingles"), null("component").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of each component one row, with all its columns: the smallest id, and of its texts the one with the smaller hash. Rows
    are told apart by id and text; of rows equal in both one stays."""
    own, text = "__ngram_join_id", "__ngram_join_text"
    rows = grouped(_ids(docs), words, percent).filter("n > 0").withColumnsRenamed({"id": own, "text_key": text})
    stands = (F.col(own) == F.col("component")) & (F.col(text) == F.col("of"))
    gone = rows.filter(~stands).select(own, text).distinct()
    twice = rows.filter(stands).groupBy(own, text).count().filter("count > 1").select(own, text)
    keyed = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)), text: F.xxhash64(F.col("text").cast("string"))})
    out = keyed.join(gone.hint("merge"), [own, text], "left_anti")
    if twice.limit(1).count():
        out = out.join(twice, [own, text], "left_anti").unionByName(out.join(twice, [own, text], "left_semi").dropDuplicates([own, text]))
    return out.drop(own, text)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, hash(list_sort(s)) AS class FROM s),
c AS (SELECT class, n, min(doc_id) AS doc_id FROM n WHERE n > 0 GROUP BY ALL),
g AS (SELECT c.doc_id, c.n, unnest(s.s) AS g FROM c JOIN s USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY held, g) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY g) AS held FROM g)),
p AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE a.rank <= a.n * 15 // 100 + 1 AND b.rank <= b.n * 15 // 100 + 1 AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
o AS (SELECT a, b, na, nb, len(list_intersect(x.s, y.s)) AS shared FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b),
e AS (SELECT a, b FROM o WHERE 100 * shared >= 85 * (na + nb - shared)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS to_ FROM c UNION SELECT r.v, d.b FROM r JOIN d ON d.a = r.to_),
k AS (SELECT v, min(to_) AS component_id FROM r GROUP BY v)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(k.component_id, n.doc_id) AS component_id FROM n LEFT JOIN c ON c.class = n.class AND c.n = n.n LEFT JOIN k ON k.v = c.doc_id
"""
