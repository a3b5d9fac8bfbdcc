"""Token counts by byte-level pair merging on ragged arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.common import ready
from cinderlog.llm.pretokens import Pieces

#: Fixed value: the split pattern of byte-level tokenizers with use_regex, as the vocabulary files' README gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = np.int32(2**31 - 1)
_SLOTS = 18


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a vocabulary: itself if it can be printed, else one above 255."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(byte) if byte in shown else chr(next(others)) for byte in range(256)]


class PairMerger:
    """Merges symbols of many byte sequences at once: in each step every sequence merges its pair of lowest rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        plain = spec["pre_tokenizer"] | {"trim_offsets": None}
        if model["type"] != "BPE" or spec["normalizer"] or plain != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": None, "use_regex": True}:
            raise ValueError("only plain byte-level pair merging is supported")
        if model.get("ignore_merges") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("tokenizer options that are not supported")
        self.specials = [token["content"] for token in spec["added_tokens"]]
        vocab = model["vocab"]
        self.bytes = np.array([vocab[symbol] for symbol in byte_symbols()], np.int64)
        pairs = [merge.split(" ") if isinstance(merge, str) else merge for merge in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.keys = np.full(1 << _SLOTS, -1, np.int64)
        self.ranks = np.full(1 << _SLOTS, NEVER, np.int32)
        slots = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # open addressing: the first to find a slot free gets it, the rest go one on
            free = np.flatnonzero(self.keys[slots[left]] == -1)
            _, winners = np.unique(slots[left][free], return_index=True)
            won = left[free[winners]]
            self.keys[slots[won]], self.ranks[slots[won]] = keys[won], won
            left = np.setdiff1d(left, won)
            slots[left] = (slots[left] + 1) & ((1 << _SLOTS) - 1)
        self.pattern = regex.compile(PATTERN)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slots = self._slot(keys)
        found = self.keys[slots]
        ranks = np.where(found == keys, self.ranks[slots], NEVER)
        on = np.flatnonzero((found != keys) & (found != -1))
        while len(on):
            slots[on] = (slots[on] + 1) & ((1 << _SLOTS) - 1)
            found = self.keys[slots[on]]
            hit = found == keys[on]
            ranks[on[hit]] = self.ranks[slots[on[hit]]]
            on = on[~hit & (found != -1)]
        return ranks

    def merge(self, sequences: list[bytes]) -> np.ndarray:
        """How many symbols are left of each sequence."""
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        counts = lengths.copy()
        owners = np.flatnonzero(lengths > 1)
        symbols = self.bytes[np.frombuffer(b"".join(sequences), np.uint8)]
        keep = np.repeat(lengths > 1, lengths)
        symbols, lengths = symbols[keep], lengths[owners]
        while len(owners):
            ends = np.cumsum(lengths)
            ranks = np.empty(len(symbols), np.int32)
            ranks[:-1] = self._rank(symbols[:-1], symbols[1:])
            ranks[ends - 1] = NEVER
            lowest = np.minimum.reduceat(ranks, ends - lengths)
            hits = np.flatnonzero((ranks == np.repeat(lowest, lengths)) & (ranks != NEVER))
            # A pair of equal symbols can overlap itself: of a run of hits every other one merges.
            run = np.flatnonzero(np.diff(hits, prepend=-2) != 1)
            place = np.arange(len(hits)) - np.repeat(run, np.diff(run, append=len(hits)))
            hits = hits[place % 2 == 0]
            symbols[hits] = self.merged[ranks[hits]]
            stays = np.ones(len(symbols), bool)
            stays[hits + 1] = False
            lengths = np.add.reduceat(stays, ends - lengths, dtype=np.int64)
            going = lowest != NEVER
            counts[owners] = lengths
            going &= lengths > 1
            stays &= np.repeat(going, np.diff(ends, prepend=0))
            symbols, owners, lengths = symbols[stays], owners[going], lengths[going]
        return counts

    def count(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece of text."""
        numbers: dict[str, int] = {}
        owned = [[numbers.setdefault(token, len(numbers)) for token in self.pattern.findall(piece)] for piece in pieces]
        counts = self.merge([token.encode() for token in numbers]).tolist()
        return [sum([counts[number] for number in row]) for row in owned]


@lru_cache(maxsize=2)
def _counter(path: str) -> tuple[PairMerger, Pieces]:
    merger = PairMerger(path)
    return merger, Pieces(merger.count, merger.specials)


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """Tokens of whole texts, special strings in them being special tokens."""
    _, pieces = _counter(path)
    parts = [pieces.parts(text) for text in texts]
    flat = iter(pieces.values([part for inside, _ in parts for part in inside]))
    return [len(special) + sum(sum(next(flat)) for _ in inside) for inside, special in parts]


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each document.

    docs: doc_id, text. path: a byte-level vocabulary file, at the same place on every machine. Counts are those of
    its library, special strings handled as it does by default. Null and empty texts have 0 bytes and 0 tokens. Each
    row is counted by itself, so repeated rows and null ids pass through, and nothing is shuffled.
    """
    ready(docs.sparkSession)

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(count_tokens(path, series.tolist()), dtype="int64")

    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"], F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
