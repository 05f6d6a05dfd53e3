"""Compares settings of the quality classifier inside its training folds: python tests/llm/choose_quality.py FOLDER

Learns from labelled rows whose crc32(doc_id) mod 5 is 1, 2 or 3 and prints log loss and rates on those where it is 4. Rows
of remainder 0 are not read.
"""

import itertools
import sys
import zlib

import numpy as np
import pyarrow.dataset as ds

from quirefold.llm import quality_classifier as Q


def labelled(folder):
    read = lambda name, *columns: zip(*(ds.dataset(f"{folder}/{name}.parquet").to_table(columns=list(columns)).column(c).to_pylist() for c in columns), strict=True)
    labels = {k: q for k, q in read("labels", "doc_id", "quality") if q in (0, 1)}
    for k, text in read("documents", "doc_id", "text"):
        fold = zlib.crc32(str(k).encode()) % 5
        if k in labels and fold:
            yield fold, labels[k], (text or "").encode(), zlib.crc32(str(k).encode() + b"order")


def main(folder):
    rows = sorted(labelled(folder), key=lambda r: r[3])
    learnt = [[t for fold, y, t, _ in rows if fold < 4 and y == c and len(t) <= Q.LONGEST] for c in (0, 1)]
    held = [(t, y) for fold, y, t, _ in rows if fold == 4]
    truth = np.array([y for _, y in held])
    for Q.BLOCK, Q.DICTIONARY_BYTES, n in itertools.product((256, 512, 1024, 4096), (16_384, 32_768, 65_536, 112_640), (400, 800)):
        first = [min(n, len(x) // 2) for x in learnt]
        bad, good = (Q.dictionary(x[:k]) for x, k in zip(learnt, first, strict=True))
        sizer = Q.Sizer(good, bad)
        known = [(sizer.sizes(t), c) for c in (0, 1) for t in learnt[c][first[c] : first[c] + n]]
        weights = Q.calibrate(Q.inputs(np.array([x for x, _ in known])), np.array([c for _, c in known], float), len(learnt[1]) / sum(map(len, learnt)))
        p = 1 / (1 + np.exp(-np.clip(Q.inputs(np.array([sizer.sizes(t) for t, _ in held])) @ weights, -500, 500)))
        loss = -np.mean(np.log(np.where(truth == 1, p, 1 - p) + 1e-9))
        print(f"block {Q.BLOCK} dictionary {Q.DICTIONARY_BYTES} texts {n}: log loss {loss:.4f}, kept of label 1 {(p[truth == 1] >= Q.KEEP_AT).mean():.4f}, of label 0 {(p[truth == 0] >= Q.KEEP_AT).mean():.4f}")


if __name__ == "__main__":
    main(sys.argv[1])
