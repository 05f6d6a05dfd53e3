"""Quality classifier by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is cut into blocks; each is compressed with both dictionaries. The difference of the two compressed sizes, over
the size of the text, says which dictionary knows it better; short texts leave more to chance, so the calibration also
sees the difference damped by length, and the damping itself. A logistic fit on labelled texts that are in no dictionary
turns this into the probability of label 1, set to the share of the label in the training rows.

The fit uses a bounded sample (DICTIONARY_TEXTS and CALIBRATION_TEXTS of each label, in the order of a hash of the id,
none longer than LONGEST bytes); every text is scored whole.

Defined results: null or empty text has no blocks and gets the calibrated score of difference 0; ids with contradictory
labels teach nothing; with only one label to learn from, or none, every score is that label's share, or 0.5; repeated
rows and ties are scored alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import arrow_batches, fold, pick, table
from quirefold.llm.textkit import as_bytes, in_slices

# Sizes, block and number of texts were chosen inside the training folds by tests/llm/choose_quality.py: learnt from the
# remainders 1 to 3 of the ids, compared by log loss on remainder 4. Rows of remainder 0 had no part in it.
DICTIONARY_TEXTS = 800
CALIBRATION_TEXTS = 800
LONGEST = 1 << 15
DICTIONARY_BYTES = 32_768
BLOCK = 256
LEVEL = 1
KEEP_AT = 0.3


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    """Content of a dictionary; too little text to train on is taken as it is."""
    import zstandard

    samples = [b for t in texts for b in blocks(t) if len(b) >= 64]
    if len(samples) >= 64:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3, k=200, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples or texts)[-DICTIONARY_BYTES:]


class Sizer:
    """Compressed sizes of a text by the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def compressor(content: bytes):
            data = zstandard.ZstdCompressionDict(content)
            data.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.good, self.bad = compressor(good), compressor(bad)

    def sizes(self, text: bytes) -> tuple[int, int, int]:
        cut = blocks(text)
        return sum(len(self.good(b)) for b in cut), sum(len(self.bad(b)) for b in cut), len(text)


def inputs(sizes: np.ndarray) -> np.ndarray:
    good, bad, n = sizes.T.astype(float)
    difference = (bad - good) / (n + 64)
    damped = 1 / (1 + n / 200)
    return np.stack([difference, difference * damped, damped, np.ones(len(n))], axis=1)


def calibrate(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Weights of a ridge logistic fit by Newton steps, moved to the share of label 1."""
    centre, scale = x[:, :-1].mean(axis=0), x[:, :-1].std(axis=0) + 1e-9
    a = np.concatenate([(x[:, :-1] - centre) / scale, x[:, -1:]], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(w)), a.T @ (p - y) + 1e-3 * w)
    own = y.mean()
    w[-1] += np.log(share / (1 - share)) - np.log(own / (1 - own)) - (w[:-1] * centre / scale).sum()
    w[:-1] /= scale
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, list[bytes]], float]:
    """Texts by label in the order of a hash of their ids, and the share of label 1."""
    clear = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter((F.col("quality") == F.col("most")) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    n = {r[0]: r[1] for r in clear.groupBy("quality").count().collect()}
    if not n:
        return {}, 0.5
    share = n.get(1, 0) / sum(n.values())
    wanted = 2 * (DICTIONARY_TEXTS + CALIBRATION_TEXTS)  # some are too long, and some ids have no text
    hashed = clear.withColumn("h", F.xxhash64("doc_id"))
    # the least of each label, found in each partition first
    first = hashed.filter("quality = 0").orderBy("h", "doc_id").limit(wanted).union(hashed.filter("quality = 1").orderBy("h", "doc_id").limit(wanted))
    # at most 2 * wanted ids, so the broadcast and the rows collected are bounded
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= LONGEST).join(F.broadcast(first), "doc_id").orderBy("h", "doc_id", "text").limit(2 * wanted).collect()
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    seen = set()
    for r in rows:
        if r["doc_id"] not in seen and len(texts[r["quality"]]) < wanted // 2:
            seen.add(r["doc_id"])
            texts[r["quality"]].append((r["text"] or "").encode())
    return texts, share


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: two dictionaries and weights, or a constant share."""
    texts, share = labelled_sample(docs, labels)
    if not texts or min(len(x) for x in texts.values()) < 2:
        return {"share": share}
    split = {c: min(DICTIONARY_TEXTS, len(x) // 2) for c, x in texts.items()}
    content = {c: dictionary(x[: split[c]]) for c, x in texts.items()}
    if not all(len(x) >= 8 for x in content.values()):
        return {"share": share}
    sizer = Sizer(content[1], content[0])
    rest = [(sizer.sizes(t), c) for c, x in texts.items() for t in x[split[c] :]]
    weights = calibrate(inputs(np.array([s for s, _ in rest])), np.array([c for _, c in rest], dtype=float), min(max(share, 1e-6), 1 - 1e-6))
    return {"share": share, "good": content[1], "bad": content[0], "weights": weights}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """The frame's columns, and score: the probability of label 1. It must have a column text."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model["good"], model["bad"]) if "weights" in model else None
        for part in in_slices(batches):
            if sizer:
                x = inputs(np.array([sizer.sizes(t or b"") for t in as_bytes(part.column("text"))]))
                got = 1 / (1 + np.exp(-np.clip(x @ model["weights"], -500, 500)))
            else:
                got = np.full(part.num_rows, float(model["share"]))
            keep = [k for k in range(part.num_columns) if part.schema.names[k] != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(got, pa.float64())], names=[*(part.schema.names[k] for k in keep), "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, schema + ", score double")


def quality_classifier(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted, learnt from the labels outside one fold of the ids."""
    texts = pick(docs, doc_id="bigint", text="string")
    known = pick(labels, doc_id="bigint", quality="int").filter((fold(F.col("doc_id"), mod) != held) & F.col("doc_id").isNotNull())
    model = fit(texts, known)
    out = score(texts.withColumn("held_out", fold(F.col("doc_id"), mod) == held), model)
    return out.withColumn("predicted", (F.col("score") >= KEEP_AT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose text is predicted good."""
    known = pick(labels, doc_id="bigint", quality="int").filter((fold(F.col("doc_id"), 5) != 0) & F.col("doc_id").isNotNull())
    model = fit(pick(docs, doc_id="bigint", text="string"), known)
    if "weights" not in model:
        return docs.filter(F.lit(model["share"] >= KEEP_AT))
    arrow_batches(docs.sparkSession)
    made: list[Sizer] = []

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:  # only the verdict comes back, not the text
        if not made:
            made.append(Sizer(model["good"], model["bad"]))
        x = inputs(np.array([made[0].sizes(t or b"") for t in as_bytes(texts)], dtype=np.int64).reshape(-1, 3))
        return pa.array(1 / (1 + np.exp(-np.clip(x @ model["weights"], -500, 500))) >= KEEP_AT)

    return docs.filter(good("text"))


def query(spark, sf_dir):
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
