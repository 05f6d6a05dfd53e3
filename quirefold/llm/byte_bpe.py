"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, decoding by the reversed byte table.

The ranks file gives bytes and ranks. Bytes become characters by the public byte table (printable bytes stand for
themselves, the others are moved above 255), so ranks become a vocabulary of strings and a merge list in order of rank;
every split of a token into two known tokens is a merge, as a rank merger would use it. Texts are cut by the pattern
first; the distinct pieces of a slice that are new are given to the library as the words of one sequence, so that an
encoding is made for thousands of pieces and not for each. What it returned is kept in a bounded table for later
slices; the round trip keeps a piece's ids in decimal and the bytes that they decode to. Token offsets are byte offsets:
a character may be split over tokens, so character offsets are derived by counting the bytes that begin a character.

Decoding concatenates token bytes. A text is only decoded from bytes as a whole, so split characters come back whole;
ids that end inside a character give U+FFFD there, as UTF-8 decoding with replacement does. A text's bytes are those of
its pieces' ids, one after another.

Defined results: null text is empty text (no ids); ids and bytes not in the vocabulary are an error; repeated rows, ties
and extra columns pass through row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, chain, pairwise
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quirefold.llm.common import arrow_batches, pick, table
from quirefold.llm.textkit import as_bytes, in_slices

RANKS = "byte_bpe_50k.tiktoken"
#: Pieces kept between slices in a worker; beyond it only those of the slice at hand stay. It bounds memory, not work.
KEPT_PIECES = 80_000
#: Pieces given to the library at once; it holds over a hundred bytes for each of their tokens.
SENT_PIECES = 20_000


def byte_table() -> list[str]:
    """The character that stands for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Kept:
    """What is kept of pieces: for each, what stands for its ids, joined."""

    def __init__(self, join: Callable, tokens: Sequence, sizes: np.ndarray):
        """tokens: what stands for each id; sizes: the length of each, joined."""
        self.join, self.tokens, self.sizes = join, tokens, sizes
        self.of: dict[str, Any] = {}

    def add(self, pieces: list[str], ids: list[int], bounds: np.ndarray) -> None:
        """bounds: where in ids each piece starts, and the last one ends."""
        joined = self.join(map(self.tokens.__getitem__, ids))
        ends = np.zeros(len(ids) + 1, dtype=np.int64)
        if ids:
            np.cumsum(self.sizes[ids], out=ends[1:])
        self.of.update(zip(pieces, (joined[a:b] for a, b in pairwise(ends[bounds].tolist())), strict=True))


class Codec:
    """Encoder and decoder of one vocabulary, built once in each worker."""

    def __init__(self, ranks_path: str, pattern: str):
        from tokenizers import Tokenizer, models

        ranks = read_ranks(ranks_path)
        chars = byte_table()
        spell = lambda token: "".join([chars[b] for b in token])
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            cuts = ((token[:k], token[k:]) for k in range(1, len(token)))
            merges += [(spell(a), spell(b)) for _, _, a, b in sorted((ranks[a], ranks[b], a, b) for a, b in cuts if ranks.get(a, rank) < rank and ranks.get(b, rank) < rank)]
        self.library = Tokenizer(models.BPE(vocab={spell(token): rank for token, rank in ranks.items()}, merges=merges))
        self.chars = "".join(chars)
        back = {c: b for b, c in enumerate(chars)}
        size = max(ranks.values()) + 1
        self.token_bytes: list[bytes | None] = [None] * size
        for text, rank in self.library.get_vocab().items():
            self.token_bytes[rank] = bytes([back[c] for c in text])
        self.token_sizes = np.array([len(token or b"") for token in self.token_bytes])
        decimal = [f"{i} " for i in range(size)]
        self.cut = regex.compile(pattern).findall
        self.ids = Kept(list, range(size), np.ones(size, dtype=np.int64))
        self.decimal = Kept("".join, decimal, np.array(list(map(len, decimal))))
        self.data = Kept(b"".join, self.token_bytes, self.token_sizes)

    def _library_ids(self, pieces: list[str]) -> tuple[list[int], np.ndarray]:
        """The ids of the pieces, one after another, and how many there are up to the end of each piece."""
        out, bounds = [], [np.zeros(1, dtype=np.int64)]
        for at in range(0, len(pieces), SENT_PIECES):
            sent = [piece.encode() for piece in pieces[at : at + SENT_PIECES]]
            # each byte becomes its character of the byte table; 0xFF stands between pieces, as UTF-8 has no such byte
            spelt = codecs.charmap_decode(b"\xff".join(sent), "strict", self.chars)[0].split(self.chars[0xFF])
            (got,) = self.library.encode_batch_fast([spelt], is_pretokenized=True, add_special_tokens=False)
            ids = got.ids
            ends = np.cumsum(self.token_sizes[ids]) if ids else np.zeros(0, dtype=np.int64)
            piece_ends = np.cumsum(np.fromiter(map(len, sent), dtype=np.int64, count=len(sent)))
            if piece_ends[-1] != (ends[-1] if ids else 0):  # the library passes over bytes that it doesn't know
                raise ValueError("the vocabulary lacks a byte of these texts")
            bounds.append(np.searchsorted(ends, piece_ends, side="right") + len(out))
            out += ids
        return out, np.concatenate(bounds)

    def _learn(self, pieces: list[list[str]], *tables: Kept) -> None:
        """Gives each table what it lacks of these pieces. The tables hold the same pieces."""
        distinct = set(chain.from_iterable(pieces))
        if len(tables[0].of) > KEPT_PIECES:
            stay = distinct.intersection(tables[0].of)
            for table in tables:
                table.of = {piece: table.of[piece] for piece in stay}
        new = list(distinct.difference(tables[0].of))
        ids, bounds = self._library_ids(new)
        for table in tables:
            table.add(new, ids, bounds)

    def encode_pieces(self, texts: list[str]) -> list[list[list[int]]]:
        """For each text, the ids of each of its pieces."""
        pieces = [self.cut(text) for text in texts]
        self._learn(pieces, self.ids)
        return [[self.ids.of[piece] for piece in one] for one in pieces]

    def round_trips(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """For each text, the number of its ids, the ids in decimal joined by spaces, and the bytes they decode to."""
        pieces = [self.cut(text) for text in texts]
        self._learn(pieces, self.decimal, self.data)
        for one in pieces:
            written = "".join(map(self.decimal.of.__getitem__, one))
            yield written.count(" "), written[:-1], b"".join(map(self.data.of.__getitem__, one))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(chain.from_iterable(one)) for one in self.encode_pieces(texts)]

    def byte_offsets(self, ids: list[int]) -> list[int]:
        """Where each token begins, in bytes of the text."""
        return [0, *accumulate(len(self.token_bytes[i]) for i in ids)][:-1] if ids else []

    def char_offsets(self, ids: list[int]) -> list[int]:
        """The character in which each token begins; several tokens may begin in one."""
        out, seen = [], 0
        for i in ids:
            token = self.token_bytes[i]
            inside = 1 if token and token[0] & 0xC0 == 0x80 else 0
            out.append(seen - inside)
            seen += sum(b & 0xC0 != 0x80 for b in token)
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.token_bytes[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    key = (ranks_path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in as_bytes(batch.column("text"))]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, and the byte and character offset of each id."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for part in in_slices(batches):
            ids = own.encode(_texts(part))
            columns = [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([own.byte_offsets(x) for x in ids], pa.list_(pa.int64())), pa.array([own.char_offsets(x) for x in ids], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "byte_offsets", "char_offsets"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, ids array<int>, byte_offsets array<bigint>, char_offsets array<bigint>")


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, text, and data: the decoded bytes. Null ids are no ids."""
    arrow_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            data = [own.decode_bytes(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.decode("utf-8", "replace") for x in data], pa.string()), pa.array(data, pa.binary())], names=["doc_id", "text", "data"])

    return pick(encoded, doc_id="bigint", ids="array<int>").mapInArrow(run, "doc_id bigint, text string, data binary")


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes each text and decodes its ids in one pass over the Arrow batches: doc_id, n_tokens, n_bytes, the sha256 of
    the ids in decimal and of the decoded bytes, and whether those are the text's own bytes."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for part in in_slices(batches):
            texts = _texts(part)
            counts, sizes, id_hashes, text_hashes, equal = [], [], [], [], []
            for text, (n_ids, written, back) in zip(texts, own.round_trips(texts), strict=True):
                counts.append(n_ids)
                sizes.append(len(back))
                id_hashes.append(hashlib.sha256(written.encode()).hexdigest())
                text_hashes.append(hashlib.sha256(back).hexdigest())
                equal.append(back == text.encode())
            columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string()), pa.array(equal, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256", "round_trip"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_bytes bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def query(spark, sf_dir):
    out = bpe_round_trip(table(spark, sf_dir, "documents"), *public_vocabulary())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "round_trip")
