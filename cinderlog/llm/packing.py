"""Packing documents into token sequences along a space-filling curve."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cinderlog.llm.bytepieces import PieceIds, holding, other_spaces
from cinderlog.llm.common import running_totals, ready
from cinderlog.llm.pretokens import Pieces
from cinderlog.sources.workspace import written

CAPACITY, END_ID = 2048, 1
DIMENSIONS, BITS, HASHED = 3, 10, 1024


class TokenIds:
    """Ids by the tokenizers library, asked once for each piece of text and remembered.

    Texts with special strings or white space beyond ASCII are cut in Python, all others over the bytes of a column.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokenizer = Tokenizer.from_file(path)
        self.type = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special = {content: np.array([i], self.type) for content, i in specials.items()}
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        token_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        token_bytes[list(vocabulary.values())] = list(map(len, vocabulary))  # a letter of byte-level tokens is a byte
        self.pieces = Pieces(self._each, list(specials))
        self.known = PieceIds(self._each, token_bytes, self.type, not any(map(str.isspace, "".join(specials))))

    def _each(self, pieces: list[str]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(one.ids, self.type) for one in encoded]

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        odd = other_spaces(texts) | holding(texts, list(self.special))
        flat, offsets = self.known.of(texts.filter(pa.array(~odd)))
        plain = (flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()))
        rest = iter(self._cut(texts.filter(pa.array(odd)).to_pylist()))
        return [next(rest if here else plain) for here in odd.tolist()]

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.pieces.parts(text) for text in texts]
        flat = iter(self.pieces.values([part for inside, _ in parts for part in inside]))
        found = []
        for inside, special in parts:
            row = list(next(flat))
            for content in special:
                row.append(self.special[content])
                row.extend(next(flat))
            found.append(np.concatenate(row))
        return found


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.default_rng(8).standard_normal((HASHED, DIMENSIONS))


def places(ids: list[np.ndarray]) -> np.ndarray:
    """Grid cells of documents: counts of hashed ids, projected to a few dimensions and squashed to even shares."""
    cells = np.zeros((len(ids), DIMENSIONS), np.int64)
    for row, one in enumerate(ids):
        counts = np.bincount((one.astype(np.int64) * 40503) % HASHED, minlength=HASHED)
        point = counts @ _directions() / max(1.0, float(np.sqrt((counts * counts).sum())))
        share = 1 / (1 + np.exp(-1.702 * point))  # close to the normal distribution's
        cells[row] = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return cells


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of each row of coordinates (Skilling's transform)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            high = (x[i] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[n - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    distance = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            distance = (distance << 1) | ((x[i] >> bit) & 1)
    return distance


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, row, curve (Hilbert key), doc_tokens, ids (little-endian, end_id last) of each document; written.

    Written because the order of all documents has to be known before ids are cut, and ids are dear to compute.
    """
    ready(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_ids(path)
        end = np.array([end_id], tokens.type)
        for batch in batches:
            arrays = [np.append(one, end) for one in tokens.of(batch["text"])]
            ids = [one.tobytes() for one in arrays]
            curve = pa.array(hilbert(places(arrays)), pa.int64())
            counts = pa.array([len(one) for one in arrays], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], curve, counts, pa.array(ids, pa.binary())], ["doc_id", "curve", "doc_tokens", "ids"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    encoded = rows.mapInArrow(encode, "doc_id long, curve long, doc_tokens long, ids binary")
    return written(encoded.withColumn("row", F.monotonically_increasing_id()), "token-ids")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in token sequences: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id, text. path: a vocabulary file of the tokenizers library, at the same place on every machine.
    Documents are laid end to end along the curve, neighbours in content next to each other, and the line is cut
    every `capacity` tokens: all sequences but the last are full, and each token lies in exactly one piece. Ties
    on the curve go by doc_id, then by row. Null and empty texts have end_id alone, repeated rows are packed each,
    an empty table gives no pieces. `ids` holds the piece's ids as little-endian 32-bit numbers.
    """
    tokens = tokenized(docs, path, end_id)
    order = [F.col("curve"), F.col("doc_id"), F.col("row")]
    line = running_totals(tokens.select("row", "curve", "doc_id", "doc_tokens"), order, "through", "doc_tokens")
    placed = tokens.select("doc_id", "row", "doc_tokens", "ids").join(line.select("row", "through"), "row")
    placed = placed.select("doc_id", "doc_tokens", "ids", (F.col("through") - F.col("doc_tokens")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = token_ids(path).type
        for batch in batches:
            rows, pieces = [], []
            ids = batch["ids"]
            for row, (size, at) in enumerate(zip(batch["doc_tokens"].to_pylist(), batch["at"].to_pylist())):
                wide = np.frombuffer(ids[row].as_py(), kind).astype("<u4")
                start = 0
                while start < size:
                    sequence, offset = divmod(at + start, capacity)
                    length = min(size - start, capacity - offset)
                    piece = wide[start : start + length].tobytes()
                    pieces.append(piece)
                    rows.append((row, start, length, zlib.crc32(piece), size, sequence, offset))
                    start += length
            if rows:
                owner, *numbers = (pa.array(column, pa.int64()) for column in zip(*rows))
                starts, lengths, sums, sizes, sequences, offsets = numbers
                arrays = [batch["doc_id"].take(owner), starts, lengths, pa.array(pieces, pa.binary()), sums, sizes, sequences, offsets]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [field.split()[0] for field in schema.split(", ")]
    return placed.mapInArrow(cut, schema)
