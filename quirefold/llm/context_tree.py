"""LM scoring by context-tree weighting of bytes.

A byte is eight binary decisions; each decision has its own context tree over the bytes before. A node's estimate is
Krichevsky-Trofimov's; a node that is split mixes its estimate half and half with the product of its children's, at all
depths, so the weight of each depth follows from what was counted. The counts are then fixed: the prediction of a byte in
a context is one number, and a text's code length is the sum over its bytes.

A context is split if one that is a byte longer occurs LEAST times in the training texts, all of them counted. The children
of a split context are those that occur as often, and one for all others; that is a partition of the contexts, so the
mixture is proper. The tree grows with the corpus, down to DEPTH bytes.

It is never in one place. A slice of documents sends each shard its distinct cells (context and byte, as one number with
the nearest byte first) once, with their counts in training texts. A shard holds whole subtrees below contexts of TOP bytes.
It weighs them upwards, the driver weighs the top of the tree (its size is bounded by the alphabet), and a shard then
weighs downwards and gives each slice the log probabilities of its cells; the slice sums over its documents. `Tree` is the
same model over texts in memory, as a restatement for tests.

The base score needs the count of each word. Words are counted by 64-bit hash: a slice of documents sends each shard of
the hash space its distinct words once, with their counts in training texts, and gets the corpus counts back; the slice
then sums over its documents. So a word of every document costs its shard one entry a slice.

A text ends with one end symbol (byte 0), which is coded too. Contexts before the start are \\n bytes.

Defined results: null is empty text, which is one end; with no training text all counts are 0 and each byte costs eight
bits; repeated rows are scored alike; a null id counts as empty text in the fold; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import arrow_batches, dropped, fold, pick, table, written
from quirefold.llm.textkit import LOWER, SLICE_BYTES, U64, as_bytes, in_slices, lay, mix, owner, prefix_sums, return_memory, span_hashes, words_of

DEPTH = 6
#: Contexts above the shards.
TOP = 3
#: Occurrences that give a context a node of its own.
LEAST = 2
SPLITS = 1 << 12
#: Decisions whose trees are computed at once on the driver.
PLACES = 32
SLICE = 1_900_000
#: Bytes of a slice whose cells are dealt, and its distinct cells, if those come first. Texts are sorted in pieces of
#: SLICE_BYTES, and so many pieces are merged at once.
CELL_SLICE = 16_000_000
CELLS = 3 << 20
PIECES = 4
END = U64(0xE0D5E0D5E0D5E0D5)  # stands for the end among word hashes


def streams(texts: list[bytes | None], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with room for a context before each text; positions to code (ends included); text of each."""
    gap = b"\n" * depth
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), dtype=np.int64, count=len(texts))
    data = LOWER[np.frombuffer(b"".join([gap + (t or b"") + b"\0" for t in texts]), dtype=np.uint8)]
    which = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(which)) + (which + 1) * depth
    return data, at, which


def pieces(texts: list[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts in lists of about limit bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shifted = x + 8.0
    product = np.zeros_like(x)
    for k in range(8):
        product += np.log(x + k)
    inverse = 1.0 / shifted
    square = inverse * inverse
    return (shifted - 0.5) * np.log(shifted) - shifted + 0.9189385332046727 + inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260))) - product


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - 1.1447298858494002


class Tree:
    """step[node, byte]: the node that one more byte of context leads to; leaves lead to themselves."""

    def __init__(self, step: np.ndarray, parent: np.ndarray, split: np.ndarray):
        self.step, self.parent, self.split = step, parent, split

    @classmethod
    def choose(cls, texts: list[bytes], depth: int = DEPTH, splits: int = SPLITS) -> Tree:
        size = sum(map(len, texts)) + len(texts)
        least = max(2, size // splits)
        step, parent, split = [np.zeros(256, dtype=np.int32)], [-1], [False]
        grown = [0]
        for d in range(1, depth + 1):
            is_open = np.zeros(len(step), dtype=bool)
            is_open[grown] = True
            counts = np.zeros(len(step) * 256, dtype=np.int64)
            so_far = cls(np.stack(step), np.array(parent), np.array(split))
            for some in pieces(texts):
                data, at, _ = streams(some, depth)
                node = so_far.leaf(data, at, d - 1).astype(np.int64)
                inside = is_open[node]
                counts += np.bincount(node[inside] * 256 + data[at[inside] - d], minlength=len(counts))
            found, grown = np.flatnonzero(counts >= least), []
            for base in np.unique(found >> 8).tolist():  # at most splits
                split[base] = True
                step[base][:] = len(step)  # all others
                step.append(np.full(256, len(step), dtype=np.int32))
                parent.append(base)
                split.append(False)
                for byte in (found[found >> 8 == base] & 255).tolist():
                    step[base][byte] = len(step)
                    grown.append(len(step))
                    step.append(np.full(256, len(step), dtype=np.int32))
                    parent.append(base)
                    split.append(False)
            if not grown:
                break
        return cls(np.stack(step), np.array(parent), np.array(split))

    def leaf(self, data: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        node = np.zeros(len(at), dtype=np.int32)
        flat = self.step.reshape(-1)
        for d in range(1, depth + 1):
            node = flat[node.astype(np.int64) * 256 + data[at - d]]
        return node

    def predictions(self, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of each byte's probability in each leaf, from counts of leaf * 256 + byte."""
        nodes = len(self.parent)
        total = np.zeros((nodes, 257))
        total[cells >> 8, (cells & 255) + 1] = counts
        for k in range(nodes - 1, 0, -1):  # children come after their parents
            total[self.parent[k]] += total[k]
        np.cumsum(total, axis=1, out=total)
        out = np.zeros((nodes, 256), dtype=np.float32)
        # each place is the decision about one bit after the bits before it, and has a context tree of its own
        for bit in range(8):
            width = 256 >> bit
            for first in range(0, 256, max(width, PLACES)):
                lows = np.arange(first, min(256, first + max(width, PLACES)), width)
                middle = lows + width // 2
                zeros, ones = total[:, middle] - total[:, lows], total[:, lows + width] - total[:, middle]
                p = np.clip(self._mixed(zeros, ones), 1e-12, 1 - 1e-12)
                for n, low in enumerate(lows):
                    half = width // 2
                    out[:, low : low + half] += np.log10(1 - p[:, n : n + 1])
                    out[:, low + half : low + width] += np.log10(p[:, n : n + 1])
        return out

    def _mixed(self, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Probability of a one in each node (of interest in the leaves) and place, mixed over the node's path."""
        nodes = len(self.parent)
        own = kt(zeros, ones)
        whole, below = own.copy(), np.zeros_like(own)
        for k in range(nodes - 1, -1, -1):
            if self.split[k]:
                whole[k] = np.logaddexp(own[k], below[k]) - np.log(2.0)
            if k:
                below[self.parent[k]] += whole[k]
        one = (ones + 0.5) / (zeros + ones + 1.0)
        weight = np.where(self.split[:, None], 1.0 / (1.0 + np.exp(np.clip(below - own, -700, 700))), 1.0)
        # a node's share is what its ancestors leave open: from the root down, sum the estimates of the path
        share, mixed = np.ones_like(own), np.zeros_like(own)
        for k in range(nodes):
            if k:
                up = self.parent[k]
                share[k], mixed[k] = share[up] * (1 - weight[up]), mixed[up]
            mixed[k] += share[k] * weight[k] * one[k]
        return mixed


def runs(values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def numbered(starts: np.ndarray, n: int) -> np.ndarray:
    """The number of the run that holds each of n places."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def levels(cells: np.ndarray, counts: np.ndarray, top: int, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth from top: node * 256 + byte, in order (odd nodes are for all others); a cell of each; the place of
    each cell among them, or -1; their counts. cells: in order, depth bytes of context and one byte."""
    n, byte, out = len(cells), (cells & U64(255)).astype(np.int64), []
    above, above_first, is_open = np.zeros(n, dtype=np.int64), np.zeros(1, dtype=np.int64), np.ones(n, dtype=bool)
    for d in range(top, depth + 1):
        prefix = cells >> U64(8 * (depth - d) + 8)
        first = runs(prefix)
        group = numbered(first, n)
        own = (np.add.reduceat(counts, first) >= LEAST)[group] | (d == 0)
        if d == top:
            reached, node = own, 2 * group
        else:
            reached = is_open & np.logical_or.reduceat(own, above_first)[above]
            node = np.where(own, 2 * group, 2 * above + 1)
        rows = np.flatnonzero(reached)
        if not len(rows):
            break
        names, one, place = np.unique(node[rows] << 8 | byte[rows], return_index=True, return_inverse=True)
        where = np.full(n, -1, dtype=np.int64)
        where[rows] = place
        out.append((names, rows[one], where, np.bincount(place, weights=counts[rows], minlength=len(names))))
        above, above_first, is_open = group, first, reached & own
    return out


def weigh(cells: np.ndarray, counts: np.ndarray, top: int, depth: int, below: np.ndarray | None = None, entry: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """For each cell: log10 of the byte's probability; for each bit the log weight of its node at top; for each bit what
    the path to a node of its own at depth leaves open and has mixed. below: weights of the nodes at depth from their own
    subtrees, for which no probability is given here (nan). entry: what the path to top leaves open and has mixed, and the
    row of it for each cell. The weights are given without entry only, and what is left open with below only."""
    n, byte = len(cells), (cells & U64(255)).astype(np.int64)
    said, up, left = np.zeros(n), np.zeros((n, 8)) if entry is None else None, None if below is None else np.zeros((n, 8, 2))
    tree = levels(cells, counts, top, depth) if n else []
    last = np.full(n, -1)
    for k, level in enumerate(tree):
        last[level[2] >= 0] = k
    for bit in range(8):
        groups, firsts, parents, sums = [], [], [], []
        for k, (names, one, _, count) in enumerate(tree):
            first = runs(names >> (8 - bit))
            ones = np.add.reduceat(np.where(names >> (7 - bit) & 1, count, 0.0), first)
            parents.append(groups[-1][tree[k - 1][2][one[first]]] if k else None)
            groups.append(numbered(first, len(names)))
            firsts.append(one[first])
            sums.append((np.add.reduceat(count, first) - ones, ones))
        held = [None] * len(tree)
        whole = None
        for k in range(len(tree) - 1, -1, -1):
            own = kt(*sums[k])
            under = np.zeros(len(own)) if whole is None else np.bincount(parents[k + 1], weights=whole, minlength=len(own))
            split = np.zeros(len(own), dtype=bool) if whole is None else np.bincount(parents[k + 1], minlength=len(own)) > 0
            held[k] = np.where(split, 1.0 / (1.0 + np.exp(np.clip(under - own, -700, 700))), 1.0)
            whole = np.where(split, np.logaddexp(own, under) - np.log(2.0), own)
            if below is not None and top + k == depth:
                whole = np.where(tree[k][0][runs(tree[k][0] >> (8 - bit))] >> 8 & 1, whole, below[firsts[k], bit])
        share = mixed = None
        for k, (names, _, where, _) in enumerate(tree):
            if k:
                share, mixed = share[parents[k]], mixed[parents[k]]
            else:
                share, mixed = (np.ones(len(firsts[0])), np.zeros(len(firsts[0]))) if entry is None else entry[0][entry[1][firsts[0]], bit].T.astype(float)
                if up is not None:
                    rows = np.flatnonzero(where >= 0)
                    up[rows, bit] = whole[groups[0][where[rows]]]
            at = np.flatnonzero(last == k)
            group = groups[k][where[at]]
            if left is not None:
                left[at, bit, 0], left[at, bit, 1] = share[group], mixed[group]
            zeros, ones = sums[k]
            mixed = mixed + share * held[k] * (ones + 0.5) / (zeros + ones + 1.0)
            share = share * (1 - held[k])
            p = np.clip(mixed[group], 1e-12, 1 - 1e-12)
            said[at] += np.log10(np.where(byte[at] >> (7 - bit) & 1, p, 1 - p))
    said[last < 0] = np.nan
    if below is not None and tree:
        deep = np.flatnonzero(top + last == depth)
        said[deep[tree[-1][0][tree[-1][2][deep]] >> 8 & 1 == 0]] = np.nan
    return said, up, left


def cells_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each byte to code, and the text of each."""
    data, at, which = streams(texts)
    out = np.zeros(len(data), dtype=U64)
    for d in range(1, DEPTH + 1):
        out <<= U64(8)
        out[d:] |= data[:-d]
    out <<= U64(8)
    out |= data
    return out[at], which


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct values of all parts, in order."""
    out = np.concatenate(parts)
    out.sort()
    return out[runs(out)]


def tallied(cells: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells in order, and how many of each are to be learnt from. Cells have 56 bits, so that the mark is
    sorted with them and no order is held."""
    marked = cells << U64(1) | learn
    marked.sort()
    names = marked >> U64(1)
    first = runs(names)
    marked &= U64(1)
    return names[first], np.add.reduceat(marked, first).astype(np.int64)


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of all parts in order, and the sums of their counts; a part has a cell once."""
    names = distinct([own for own, _ in parts])
    counts = np.zeros(len(names), dtype=np.int64)
    for own, count in parts:
        counts[np.searchsorted(names, own)] += count
    return names, counts


def short(cells: np.ndarray) -> np.ndarray:
    """The cells with TOP bytes of context."""
    return cells >> U64(8 * (DEPTH - TOP) + 8) << U64(8) | cells & U64(255)


def shard_of(cells: np.ndarray, shards: int) -> np.ndarray:
    return (mix(cells >> U64(8 * (DEPTH - TOP) + 8)) % U64(shards)).astype(np.int64)


def in_pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in lists of about SLICE_BYTES, with the number of the first."""
    base = 0
    for some in pieces(texts, SLICE_BYTES):
        yield base, some
        base += len(some)


def packed(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def cell_slices(docs: DataFrame, shards: int) -> DataFrame:
    """For each slice of documents a row with its texts (shard -1), and for each shard its distinct cells and their counts
    in training texts."""
    arrow_batches(docs.sparkSession)

    def rows(ids: list, keys: list, texts: list[bytes], held: list, found: list) -> Iterator[pa.RecordBatch]:
        names, counts = joined(found)
        found.clear()
        shard = shard_of(names, shards)
        order = np.argsort(shard, kind="stable")
        names, counts, shard = names[order], counts[order], shard[order]
        cuts = np.append(runs(shard), len(shard))
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        slice_ = uuid.uuid4().int >> 65
        none = [None] * len(spans)
        columns = (
            [slice_] * (len(spans) + 1), [-1, *(int(shard[a]) for a, _ in spans)], [ids, *none], [keys, *none], [held, *none],
            [packed(np.frombuffer(b"".join(texts), np.uint8)), *(packed(names[a:b]) for a, b in spans)], [packed(sizes), *(packed(counts[a:b]) for a, b in spans)],
        )
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["slice", "shard", "ids", "keys", "held", "body", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, size = ([], [], [], []), [], 0
        for piece in in_slices(batches):
            texts, out = [t or b"" for t in as_bytes(piece.column("text"))], piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for own, more in zip(held, (piece.column("doc_id").to_pylist(), piece.column("text_key").to_pylist(), texts, out.tolist()), strict=True):
                own.extend(more)
            cells, which = cells_of(texts)
            found.append(tallied(cells, ~out[which]))
            size += sum(map(len, texts))
            if len(found) > PIECES or sum(len(own) for own, _ in found) >= CELLS:
                found = [joined(found)]
            if size >= CELL_SLICE or len(found[0][0]) >= CELLS:
                yield from rows(*held, found)
                held, found, size = ([], [], [], []), [], 0
        if held[0]:
            yield from rows(*held, found)

    return docs.select("doc_id", "text_key", "text", "held_out").mapInArrow(run, "slice bigint, shard bigint, ids array<bigint>, keys array<bigint>, held array<boolean>, body binary, sizes binary")


def merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The cells of a shard in order, their counts, and the places of those of each row."""
    return_memory()
    own = [unpacked(x, U64) for x in pdf["body"]]
    names, counts = joined([(x, unpacked(y, np.int64)) for x, y in zip(own, pdf["sizes"], strict=True)])
    return names, counts, [np.searchsorted(names, x).astype(np.int32) for x in own]


def tree_scores(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, held_out, score and n_bytes (ends included)."""
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    slices = written(cell_slices(docs, shards))
    dealt = slices.filter("shard >= 0").select("slice", "shard", "body", "sizes")

    def upwards(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, counts, _ = merged(pdf)
        _, up, _ = weigh(cells, counts, TOP, DEPTH)
        names, one, place = np.unique(short(cells), return_index=True, return_inverse=True)
        return pd.DataFrame([{"cells": packed(names), "counts": packed(np.bincount(place, weights=counts, minlength=len(names))), "up": packed(up[one].reshape(-1))}])

    tops = dealt.groupBy("shard").applyInPandas(upwards, "cells binary, counts binary, up binary").collect()  # contexts of TOP bytes
    cells, counts, up = (np.concatenate([np.zeros(0, t), *(unpacked(r[k], t) for r in tops)]) for k, t in enumerate((U64, float, float)))
    order = np.argsort(cells)
    cells, counts, up = cells[order], counts[order], up.reshape(-1, 8)[order]
    said, _, left = weigh(cells, counts, 0, TOP, below=up)
    shared = spark.sparkContext.broadcast((cells, said, left))

    def downwards(pdf: pd.DataFrame) -> pd.DataFrame:
        tops, known, entry = shared.value
        cells, counts, own = merged(pdf)
        place = np.searchsorted(tops, short(cells))
        said, _, _ = weigh(cells, counts, TOP, DEPTH, entry=(entry, place))
        said = np.where(np.isnan(said), known[place], said).astype(np.float32)
        return pd.DataFrame({"slice": pdf["slice"], "shard": pdf["shard"], "said": [packed(said[x]) for x in own]})

    def sums(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        return_memory()
        out = []
        known = np.concatenate([unpacked(x, np.float32) for x in parts.sort_values("shard")["said"]])
        for _, s in own.iterrows():
            data, ends = unpacked(s["body"], np.uint8).tobytes(), np.cumsum(unpacked(s["sizes"], np.int64)).tolist()
            texts = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            found = []
            for _, some in in_pieces(texts):  # once for the names and once for the sums, as places of all bytes would be held
                found.append(distinct([cells_of(some)[0]]))
                if len(found) > PIECES:
                    found = [distinct(found)]
            names = distinct(found)
            said = np.empty(len(names), dtype=np.float32)
            said[np.argsort(shard_of(names, shards), kind="stable")] = known
            score, n_bytes = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
            for base, some in in_pieces(texts):
                cells, which = cells_of(some)
                own_names, place = np.unique(cells, return_inverse=True)
                n = len(some)
                score[base : base + n] = np.bincount(which, weights=said[np.searchsorted(names, own_names)][place], minlength=n)
                n_bytes[base : base + n] = np.bincount(which, minlength=n)
            out.append(pd.DataFrame({"doc_id": pd.array(s["ids"], dtype="Int64"), "text_key": s["keys"], "held_out": s["held"], "score": score, "n_bytes": n_bytes}))
        return pd.concat(out)

    told = dealt.groupBy("shard").applyInPandas(downwards, "slice bigint, shard bigint, said binary")
    bodies = slices.filter("shard < 0").select("slice", "ids", "keys", "held", "body", "sizes")
    return bodies.groupBy("slice").cogroup(told.groupBy("slice")).applyInPandas(sums, "doc_id bigint, text_key bigint, held_out boolean, score double, n_bytes bigint")


def word_slices(docs: DataFrame) -> DataFrame:
    """One row a slice of documents: distinct word hashes in order, their counts in training texts, and for each hash the
    documents that hold it and how often."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_slices(batches, limit=SLICE):
            data, starts, _ = lay(as_bytes(piece.column("text")))
            data = LOWER[data]
            left, right = words_of(data)
            n = piece.num_rows
            hashes = np.concatenate((span_hashes(prefix_sums(data), left, right), np.full(n, END)))
            which = np.concatenate((owner(starts, left), np.arange(n)))
            learn = ~piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            names, place = np.unique(hashes, return_inverse=True)
            trained = np.bincount(place, weights=learn[which], minlength=len(names)).astype(np.int64)
            pair, times = np.unique(place * n + which, return_counts=True)
            sizes = np.bincount(pair // n, minlength=len(names)).astype(np.int32)
            row = (uuid.uuid4().int >> 65, piece.column("doc_id").to_pylist(), piece.column("text_key").to_pylist(), names.tobytes(), trained.tobytes(), sizes.tobytes(), (pair % n).astype(np.int32).tobytes(), times.astype(np.int32).tobytes())
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["slice", "ids", "keys", "hashes", "trained", "sizes", "docs", "times"])

    return docs.select("doc_id", "text", "text_key", "held_out").mapInArrow(run, "slice bigint, ids array<bigint>, keys array<bigint>, hashes binary, trained binary, sizes binary, docs binary, times binary")


def word_counts(slices: DataFrame, shards: int) -> DataFrame:
    """slice, shard, and the corpus counts of the slice's hashes in that shard; the shard's totals."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, hashes, trained in zip(*(batch.column(c).to_pylist() for c in ("slice", "hashes", "trained")), strict=True):
                hashes, trained = np.frombuffer(hashes, np.uint64), np.frombuffer(trained, np.int64)
                shard = ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)  # in order, as the hashes are
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(hashes)]))
                spans = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a, _ in spans], pa.int64()), pa.array([name] * len(spans), pa.int64()), pa.array([hashes[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([trained[a:b].tobytes() for a, b in spans], pa.binary())], names=["shard", "slice", "hashes", "trained"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, trained = np.frombuffer(b"".join(pdf["hashes"]), np.uint64), np.frombuffer(b"".join(pdf["trained"]), np.int64)
        names, place = np.unique(hashes, return_inverse=True)
        totals = np.bincount(place, weights=trained, minlength=len(names)).astype(np.int64)
        ends = np.cumsum([len(x) // 8 for x in pdf["hashes"]])
        back = [x.tobytes() for x in np.split(totals[place], ends[:-1])]
        first = np.arange(len(pdf)) == 0
        return pd.DataFrame({"slice": pdf["slice"], "shard": pdf["shard"], "counts": back, "tokens": np.where(first, totals.sum(), 0), "types": np.where(first, (totals > 0).sum(), 0)})

    dealt = slices.select("slice", "hashes", "trained").mapInArrow(deal, "shard bigint, slice bigint, hashes binary, trained binary")
    return dealt.groupBy("shard").applyInPandas(add, "slice bigint, shard bigint, counts binary, tokens bigint, types bigint")


def base_scores(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_tokens, n_known, train_tokens, base_score: unigram words with one added to each count."""
    spark = docs.sparkSession
    slices = written(word_slices(docs))
    counts = written(word_counts(slices, max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())))
    n, v = (x or 0 for x in counts.agg(F.sum("tokens"), F.sum("types")).first())

    def run(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, s in own.iterrows():
            count = np.frombuffer(b"".join(parts.sort_values("shard")["counts"]), np.int64)
            sizes = np.frombuffer(s["sizes"], np.int32)
            which, times = np.frombuffer(s["docs"], np.int32), np.frombuffer(s["times"], np.int32)
            each = np.repeat(count, sizes)
            rows = len(s["ids"])
            tokens = np.bincount(which, weights=times, minlength=rows).astype(np.int64)
            base = np.bincount(which, weights=times * np.log10(each + 1.0), minlength=rows) - tokens * np.log10(n + v + 1.0)
            out.append(pd.DataFrame({"doc_id": pd.array(s["ids"], dtype="Int64"), "text_key": s["keys"], "n_tokens": tokens, "n_known": np.bincount(which, weights=times * (each > 0), minlength=rows).astype(np.int64), "train_tokens": n, "base_score": base}))
        return pd.concat(out)

    kept = slices.select("slice", "ids", "keys", "sizes", "docs", "times")
    out = kept.groupBy("slice").cogroup(counts.select("slice", "shard", "counts").groupBy("slice")).applyInPandas(run, "doc_id bigint, text_key bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double")
    out = written(out)
    dropped(slices, counts)
    return out


def lm_score(docs: DataFrame, mod: int = 7, held: int = 2) -> DataFrame:
    """All texts scored by the unigram base and by the tree learnt outside one fold of the ids."""
    df = pick(docs, doc_id="bigint", text="string").withColumn("held_out", fold(F.col("doc_id"), mod) == held).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    base = base_scores(df).dropDuplicates(["doc_id", "text_key"])
    scored = tree_scores(df)
    same = scored["doc_id"].eqNullSafe(base["doc_id"]) & (scored["text_key"] == base["text_key"])
    return scored.join(base, same).select(scored["doc_id"], "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", (-F.col("score") * F.lit(3.321928094887362) / F.col("n_bytes")).alias("bits_per_byte"))


def query(spark, sf_dir):
    return lm_score(table(spark, sf_dir, "documents"))
