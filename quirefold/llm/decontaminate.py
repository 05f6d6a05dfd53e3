"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are the runs outside 0x20 and 0x09-0x0D, with A-Z lower-cased. The seeds of an item are its word 3-grams that are
rare: the product of their words' shares of the corpus is at most RARE (shares are counted over all documents, for the
words of the items only); an item has its FEWEST rarest 3-grams as seeds in any case, and the rarest one of each RUN words
in a row, so no verbatim run of that length is without a seed. Where a seed stands in a document,
the passage around it, as long as the item and half as long again at each side, is aligned with the item word by word:
MATCH for equal words, MISMATCH and GAP for edits. The score is the best local alignment over that of the item with
itself, so 1 is an exact copy. A pair is reported if the score reaches THRESHOLD, or if RUN words in a row are the item's,
however long the item is. Rarity comes from words, not from how often the 3-gram stands in the corpus, so an item that was
copied often does not hide itself.

An item of one or two words has one seed, all of it, and is reported wherever its words stand in a row.

The items are the stated query set: they go to the workers in blocks of BLOCK_WORDS words, PER_PASS blocks with a pass over
all documents, so what is sent and held is bounded for any number of items.

Defined results: null or empty texts and items hold nothing and are never reported; repeated items and documents are each
reported; null ids stay null; of equal alignments the first is reported; a text of any length is searched whole, in
passages of bounded length; extra columns are ignored by leaks and carried by keep_clean, whatever their names; empty
tables give no pairs, and keep_clean without items keeps all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.common import arrow_batches, pick, table
from quirefold.llm.textkit import LOWER, U64, as_bytes, gram_hashes, in_slices, lay, owner, prefix_sums, slices, span_hashes, words_of

N = 3
RARE = 1e-9
FEWEST = 12
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.4
RUN = 16
BLOCK_WORDS = 1 << 20
PER_PASS = 8  # blocks that one pass over the documents serves
TOGETHER = 64  # alignments that are computed at once


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, start and end byte (in its text) of each word, and where each text's words begin."""
    data, starts, _ = lay(texts)
    data = LOWER[data]
    left, right = words_of(data)
    which = owner(starts, left)
    first = np.searchsorted(which, np.arange(len(texts) + 1))
    return span_hashes(prefix_sums(data), left, right), which, left - starts[which], right - starts[which], first


class Table:
    """Grams in order of hash, with the item and the place in it of each."""

    def __init__(self, grams: np.ndarray, item: np.ndarray, place: np.ndarray):
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.place = grams[order], item[order], place[order]
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self.grams >> U64(42)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a position in grams and a seed that is equal."""
        at = np.flatnonzero(self.bits[grams >> U64(42)])
        a = np.searchsorted(self.grams, grams[at], side="left")
        n = np.searchsorted(self.grams, grams[at], side="right") - a
        at, a, n = at[n > 0], a[n > 0], n[n > 0]
        return np.repeat(at, n), np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Seeds:
    """Rare grams of a block of items: tables by the number of words, N and, for shorter items, all their words."""

    def __init__(self, ids: list[int], texts: list[bytes | None], shares: dict[int, float]):
        words, which, _, _, first = word_hashes(texts)
        self.ids = ids
        self.items = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        seen = np.array([shares.get(int(w), 0.0) for w in words])
        logs = np.log(np.maximum(seen, 1e-300)) if len(words) else np.zeros(0)
        grams = gram_hashes(words, N)
        chance = sum(logs[k : k + len(grams)] for k in range(N)) if len(grams) else np.zeros(0)
        known = np.array([seen[k : k + N].all() for k in range(len(grams))], dtype=bool)  # others stand in no document
        keep = np.zeros(len(grams), dtype=bool)
        for a, b in zip(first[:-1], first[1:], strict=True):
            own = np.arange(a, max(a, b - N + 1))
            rank = np.empty(len(own), dtype=np.int64)
            rank[np.argsort(np.where(known[own], chance[own], np.inf), kind="stable")] = np.arange(len(own))
            keep[own] = (chance[own] <= np.log(RARE)) | (rank < FEWEST)
            for k in range(len(own) - (RUN - N)):  # the rarest of each run of RUN words
                keep[own[k + int(chance[own[k : k + RUN - N + 1]].argmin())]] = True
        keep &= known
        at = np.flatnonzero(keep)
        self.tables = {N: Table(grams[at], which[at], at - first[which[at]])} if len(at) else {}
        sizes = np.diff(first)
        for n in range(1, N):
            short = np.flatnonzero(sizes == n)
            if len(short):
                whole = np.array([gram_hashes(self.items[k], n)[0] for k in short], dtype=np.uint64)
                self.tables[n] = Table(whole, short, np.zeros(len(short), dtype=np.int64))


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of each item with its passage, all at once along antidiagonals: best score, first and last aligned
    word of the passage, and the most words in a row that both have."""
    k, m, w = len(items), max(map(len, items)), max(map(len, passages))
    x, y = np.zeros((k, m), dtype=np.uint64), np.zeros((k, w), dtype=np.uint64)
    in_x, in_y = np.zeros((k, m), dtype=bool), np.zeros((k, w), dtype=bool)
    for i, (a, b) in enumerate(zip(items, passages, strict=True)):
        x[i, : len(a)], in_x[i, : len(a)] = a, True
        y[i, : len(b)], in_y[i, : len(b)] = b, True
    best, start, end = np.zeros(k, dtype=np.int32), np.zeros(k, dtype=np.int32), np.zeros(k, dtype=np.int32)
    # cell (i, j) stands at index i + 1 of antidiagonal i + j; from: first passage word of the cell's alignment
    score1, score2 = np.zeros((k, m + 1), dtype=np.int32), np.zeros((k, m + 1), dtype=np.int32)
    from1, from2 = np.zeros((k, m + 1), dtype=np.int32), np.zeros((k, m + 1), dtype=np.int32)
    run1, run2 = np.zeros((k, m + 1), dtype=np.int32), np.zeros((k, m + 1), dtype=np.int32)
    longest = np.zeros(k, dtype=np.int32)
    for d in range(m + w - 1):
        lo, hi = max(0, d - w + 1), min(m, d + 1)
        i = np.arange(lo, hi)
        j = d - i
        equal = (x[:, i] == y[:, j]) & in_x[:, i] & in_y[:, j]
        slant = score2[:, i] + np.where(equal, MATCH, MISMATCH)
        slant_from = np.where(score2[:, i] > 0, from2[:, i], j)
        up, left = score1[:, i] + GAP, score1[:, i + 1] + GAP
        new = np.maximum(np.maximum(slant, 0), np.maximum(up, left))
        origin = np.where(new == slant, slant_from, np.where(new == up, from1[:, i], from1[:, i + 1]))
        score, source, run = np.zeros_like(score1), np.zeros_like(from1), np.zeros_like(run1)
        run[:, i + 1] = (run2[:, i] + 1) * equal
        np.maximum(longest, run.max(axis=1), out=longest)
        score[:, i + 1] = new * (in_x[:, i] & in_y[:, j])
        source[:, i + 1] = origin
        top = score[:, i + 1].argmax(axis=1)
        value = score[np.arange(k), i[top] + 1]
        better = value > best
        best[better], start[better], end[better] = value[better], source[np.arange(k), i[top] + 1][better], j[top][better]
        score1, score2, from1, from2, run1, run2 = score, score1, source, from1, run, run1
    return best, start, end, longest


def passages(text: np.ndarray, item: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, item, first word and one past the last word of each passage around seeds. begin: where the item would begin.

    Seeds of a pair whose items would begin within half an item of each other share a passage. A passage over six items long
    is cut into such passages that share three: no alignment that scores is longer."""
    order = np.lexsort((begin, item, text))
    text, item, begin, size = text[order], item[order], begin[order], size[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > size[1:] // 2)
    heads = np.flatnonzero(new)
    tails = np.concatenate((heads[1:], [len(text)])) - 1
    text, item, size = text[heads], item[heads], size[heads]
    pad = size // 2 + 2
    lo = np.maximum(begin[heads] - pad, first[text])
    hi = np.minimum(begin[tails] + size + pad, first[text + 1])
    parts = np.maximum(1, -(-(hi - lo - 3 * size) // (3 * size)))
    which = np.repeat(np.arange(len(lo)), parts)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    a = lo[which] + k * 3 * size[which]
    return text[which], item[which], a, np.where(k == parts[which] - 1, hi[which], np.minimum(a + 6 * size[which], hi[which]))


def find(texts: list[bytes | None], seeds: Seeds, threshold: float, least_run: int = RUN) -> list[tuple[int, int, float, int, int, int]]:
    """(text, item, score, run, start byte, end byte) of the best alignment of each pair that is reported."""
    words, which, left, right, first = word_hashes(texts)
    found: dict[tuple[int, int], tuple] = {}
    for n, table in seeds.tables.items():
        at, seed = table.hits(gram_hashes(words, n))
        inside = which[at] == which[at + n - 1] if len(at) else np.zeros(0, dtype=bool)
        at, seed = at[inside], seed[inside]
        if not len(at):
            continue
        if n < N:  # the seed is the item
            pairs, one = np.unique(np.stack([which[at], table.item[seed]]), axis=1, return_index=True)
            for (t, i), a in zip(pairs.T.tolist(), at[one].tolist(), strict=True):
                found[t, i] = (1.0, n, -a, int(left[a]), int(right[a + n - 1]))
            continue
        sizes = np.array([len(x) for x in seeds.items], dtype=np.int64)
        text, item, lo, hi = passages(which[at], table.item[seed], at - table.place[seed], sizes[table.item[seed]], first)
        by_length = np.argsort(hi - lo, kind="stable")
        for k in range(0, len(by_length), TOGETHER):
            some = by_length[k : k + TOGETHER]
            best, start, end, runs = align([seeds.items[i] for i in item[some]], [words[a:b] for a, b in zip(lo[some], hi[some], strict=True)])
            for c, top, a, b, run in zip(some.tolist(), best.tolist(), (lo[some] + start).tolist(), (lo[some] + end).tolist(), runs.tolist(), strict=True):
                score = top / (MATCH * int(sizes[item[c]]))
                key = (int(text[c]), int(item[c]))
                if (score >= threshold or run >= least_run) and (key not in found or (score, run, -a) > found[key][:3]):
                    found[key] = (score, run, -a, int(left[a]), int(right[b]))
    return [(t, i, s, run, a, b) for (t, i), (s, run, _, a, b) in sorted(found.items())]


def word_shares(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, float]:
    """Share of the corpus's words of each word of a sorted block vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, dtype=np.int64)
        for part in in_slices(batches):
            words = word_hashes(as_bytes(part.column("text")))[0]
            spot = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            total[:-1] += np.bincount(spot[vocabulary[spot] == words], minlength=len(vocabulary))
            total[-1] += len(words)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], names=["k", "n"])

    if not len(vocabulary):
        return {}
    rows = docs.select("text").mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()  # a block's words at most
    counts = {r[0]: r[1] for r in rows}
    n = max(counts.get(len(vocabulary), 0), 1)
    return {int(w): counts.get(k, 0) / n for k, w in enumerate(vocabulary)}


def seed_blocks(docs: DataFrame, items: DataFrame) -> Iterator[list[Seeds]]:
    """The items as seeds, in blocks, and those in the lists that one pass serves."""
    spark = docs.sparkSession
    arrow_batches(spark)
    sized = pick(items, item_id="bigint", text="string").filter(F.octet_length("text") > 0).withColumn("words", F.size(F.split("text", r"[\x20\x09-\x0D]+")))
    whole = sized.agg(F.sum("words")).first()[0] or 0
    blocks = -(-whole // BLOCK_WORDS)
    for first in range(0, blocks, PER_PASS):
        parts = []
        for k in range(first, min(first + PER_PASS, blocks)):
            rows = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").orderBy("item_id", "text").collect()  # about BLOCK_WORDS words
            parts.append(([r[0] for r in rows], [r[1].encode() for r in rows]))
        shares = word_shares(docs, np.unique(np.concatenate([word_hashes(texts)[0] for _, texts in parts])))
        yield [Seeds(ids, texts, shares) for ids, texts in parts]


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, run, and start_byte and end_byte of the passage in the text."""
    texts = pick(docs, doc_id="bigint", text="string")
    schema = "doc_id bigint, item_id bigint, score double, run bigint, start_byte bigint, end_byte bigint"
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())

    def one(seeds: list[Seeds]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(seeds)  # PER_PASS blocks of items at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in in_slices(batches):
                ids, texts = part.column("doc_id").to_pylist(), as_bytes(part.column("text"))
                rows = [(ids[t], own.ids[i], s, run, a, b) for own in shared.value for t, i, s, run, a, b in find(texts, own, threshold)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "score", "run", "start_byte", "end_byte"])

        return texts.mapInArrow(run, schema)

    found = [one(seeds) for seeds in seed_blocks(texts, items)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], T._parse_datatype_string(schema))


def _clean(shared, threshold: float):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:  # only the verdict comes back, not the text
        stays = np.ones(len(texts), dtype=bool)
        at = 0
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"])) if len(texts) else ():
            held = as_bytes(part.column("text"))
            stays[[at + x[0] for own in shared.value for x in find(held, own, threshold)]] = False
            at += part.num_rows
        return pa.array(stays)

    return clean


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text holds no copy of an item."""
    out = docs
    for seeds in seed_blocks(pick(docs, text="string"), items):
        out = out.filter(_clean(docs.sparkSession.sparkContext.broadcast(seeds), threshold)("text"))
    return out


def query(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
