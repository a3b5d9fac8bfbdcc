"""Ids by pieces over bytes against the library on whole texts."""

import random

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cinderlog.llm.bytepieces import PieceIds
from cinderlog.llm.packing import TokenIds

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the", "ing", " ", " ", " ", "  ", "\n", "\t", "é", "漢", "😀", "\x85", " ", "\xa0", "\x1c", "​", "<|endoftext|>", "1", "'s", ".", "Â", "\x0b"]


@pytest.mark.parametrize("most_bytes, joined", [(32 << 20, 500), (2000, 3), (0, 1)])
def test_ids_equal_the_library(monkeypatch, most_bytes, joined):
    monkeypatch.setattr(PieceIds, "MOST_BYTES", most_bytes)
    monkeypatch.setattr(PieceIds, "JOINED", joined)
    draw, tokens, library = random.Random(joined), TokenIds(PATH), Tokenizer.from_file(PATH)
    for _ in range(150):
        texts = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(30))) for _ in range(draw.randrange(40))]
        texts += [" " * draw.randrange(4) + "x" * draw.randrange(300)]
        found = tokens.of(pa.array(["skipped", *texts], pa.string())[1:])
        assert [one.tolist() for one in found] == [one.ids for one in library.encode_batch(texts, add_special_tokens=False)]


def test_other_vocabularies_are_asked_piece_by_piece():
    tokens, library = TokenIds(PATH), Tokenizer.from_file(PATH)
    tokens.known.token_bytes[:] = 2  # as if letters of tokens were no bytes
    texts = ["one two three four", "five six two"]
    assert [one.tolist() for one in tokens.of(pa.array(texts))] == [one.ids for one in library.encode_batch(texts, add_special_tokens=False)]
