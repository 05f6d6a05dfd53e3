"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and every run of non-letters becomes one space. Each 1-, 2- and 3-gram of that stream is hashed
into one of 2**16 places of its order. Training counts places by language in all training rows (map side first, so a
row of the exchange is a language and a place, not a gram); the log-probability matrix has languages x 3 x 2**16
entries. It is made and sent to the workers for TOGETHER languages at a time; with more languages the texts pass through
several comparisons, each of which keeps the best so far. A batch is scored sparsely: the rows of the matrix at the grams
that occur, summed over each text. A gram that begins before its text has spaces there.

Defined results: a text that is null or has no letter is `und` with score 0; with nothing to learn from, every text is;
ties go to the language that sorts first; repeated rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import arrow_batches, fold, pick, table
from quirefold.llm.textkit import U64, as_bytes, in_slices

ORDERS = (1, 2, 3)
PLACES = 1 << 16
SMOOTHING = 0.5
#: Languages that are counted and compared at once, 50 MB of the matrix; more take further passes.
TOGETHER = 64
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter (surrogates are not)."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all grams of all texts, the text of each, and whether a text has a letter."""
    low = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) for t in low), dtype=np.int64, count=len(low))
    chars = np.frombuffer(" ".join(low + [""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    is_letter = letters()[chars]
    text = np.repeat(np.arange(len(low)), sizes + 1)
    has = np.bincount(text[is_letter], minlength=len(low)) > 0
    stays = is_letter.copy()
    stays[1:] |= is_letter[:-1]  # one space after each run of letters
    chars = np.where(is_letter, chars, np.uint32(0x20))[stays].astype(U64)
    text, is_letter = text[stays], is_letter[stays]
    places, owners = [], []
    mixed = chars * U64(0x9E3779B97F4A7C15)
    first = np.searchsorted(text, np.arange(len(low)))
    for order in ORDERS:
        if order > 1:  # grams reach back, before the text there are spaces
            older = np.full(len(chars), 0x20, dtype=U64)
            older[order - 1 :] = chars[: len(chars) - order + 1]
            for k in range(order - 1):
                head = first + k
                head = head[head < len(chars)]
                older[head[text[head] == text[head - k]]] = 0x20
            mixed = (mixed ^ (mixed >> U64(31))) * U64(0xBF58476D1CE4E5B9) + older * U64(0x94D049BB133111EB)
        use = is_letter if order == 1 else np.ones(len(chars), dtype=bool)
        places.append(((mixed ^ (mixed >> U64(29))) * U64(0xD6E8FEB86659FD93) >> U64(48)).astype(np.int64)[use] + (order - 1) * PLACES)
        owners.append(text[use])
    return np.concatenate(places), np.concatenate(owners), has


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in as_bytes(batch.column("text"))]


def languages(rows: DataFrame) -> dict[str, int]:
    """Training rows of each language, in order of name."""
    return dict(sorted((r[0], r[1]) for r in rows.groupBy("lang").count().collect()))


def train(rows: DataFrame, langs: list[str]) -> np.ndarray:
    """Log-probability matrix (places x languages) of some languages. rows: text, lang."""
    arrow_batches(rows.sparkSession)
    size = len(ORDERS) * PLACES
    number = {x: k for k, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in in_slices(batches):
            which = np.array([number[x] for x in part.column("lang").to_pylist()], dtype=np.int64)
            places, owners, _ = features(_texts(part))
            for k in np.unique(which):
                found = np.bincount(places[which[owners] == k], minlength=size)
                some = np.flatnonzero(found)
                cells, at = np.unique(np.concatenate((cells, k * size + some)), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate((counts, found[some])), minlength=len(cells)).astype(np.int64)
        for at in range(0, len(cells), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(cells[cut] // size, pa.int32()), pa.array(cells[cut] % size, pa.int32()), pa.array(counts[cut], pa.int64())], names=["k", "place", "n"])

    # at most TOGETHER x places rows, whatever the input
    wanted = rows.filter(F.col("lang").isin(langs)).select("text", "lang")
    found = wanted.mapInArrow(count, "k int, place int, n bigint").groupBy("k", "place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((size, len(langs)))
    counts[found["place"].to_numpy(), found["k"].to_numpy()] = found["n"].to_numpy()
    matrix = np.empty((size, len(langs)), dtype=np.float32)
    for order in range(len(ORDERS)):
        own = counts[order * PLACES : (order + 1) * PLACES] + SMOOTHING
        matrix[order * PLACES : (order + 1) * PLACES] = np.log(own / own.sum(axis=0))
    return matrix


def compared(docs: DataFrame, names: list[str], matrix: np.ndarray, priors: np.ndarray) -> DataFrame:
    """The frame, after these languages have been compared with those before: best (the language), top (its log probability)
    and rest (the sum of all probabilities so far over its own)."""
    arrow_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((names, matrix, priors))  # TOGETHER x places entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log_p, priors = model.value
        for part in in_slices(batches):
            n = part.num_rows
            places, owners, has = features(_texts(part))
            sums = np.empty((n, len(names)))
            for k in range(len(names)):
                sums[:, k] = np.bincount(owners, weights=log_p[:, k][places], minlength=n) + priors[k]
            own = sums.argmax(axis=1)
            top = sums[np.arange(n), own]
            rest = np.exp(sums - top[:, None]).sum(axis=1)
            best = [names[b] if h else None for b, h in zip(own, has, strict=True)]
            before = part.column("best").to_pylist()
            if any(x is not None for x in before):
                old_top, old_rest = (part.column(c).to_numpy(zero_copy_only=False) for c in ("top", "rest"))
                stays = old_top >= top  # earlier names win ties
                high = np.maximum(old_top, top)
                rest = rest * np.exp(top - high) + old_rest * np.exp(old_top - high)
                best = [b if s else a for a, b, s in zip(best, before, stays, strict=True)]
                top = high
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), part.column("text"), pa.array(best, pa.string()), pa.array(top, pa.float64()), pa.array(rest, pa.float64())], names=["doc_id", "held_out", "text", "best", "top", "rest"])

    return docs.mapInArrow(run, "doc_id bigint, held_out boolean, text string, best string, top double, rest double")


def language_id(docs: DataFrame, mod: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior of the predicted language) of all rows, learnt from the rows
    outside one fold of the ids. Languages are compared TOGETHER at a time, so that no worker holds more of the matrix."""
    df = pick(docs, doc_id="bigint", text="string", lang="string").withColumn("held_out", fold(F.col("doc_id"), mod) == held)
    rows = df.filter(~F.col("held_out") & F.col("lang").isNotNull()).select("text", "lang")
    known = languages(rows)
    names, total = list(known), sum(known.values())
    out = df.select("doc_id", "held_out", "text", F.lit(None).cast("string").alias("best"), F.lit(0.0).alias("top"), F.lit(1.0).alias("rest"))
    for at in range(0, len(names), TOGETHER):
        some = names[at : at + TOGETHER]
        out = compared(out, some, train(rows, some), np.log((np.array([known[x] for x in some]) + 1) / (total + len(names))))
    return out.select("doc_id", "held_out", F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col("best").isNotNull(), 1 / F.col("rest")).otherwise(0.0).alias("score"))


def query(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))
