"""Token counts and packing against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cinderlog.llm.packing import hilbert, pack
from cinderlog.llm.tokens import count_tokens, token_counts

from .conftest import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(library, texts):
    return [one.ids for one in library.encode_batch(list(texts), add_special_tokens=False)]


def test_counts_equal_the_library_on_random_strings(library):
    draw = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'", "<|endoftext|>", "<|endo", "é", "漢字", "\x1c", "\x85", "1", "23", ".", "!!", "\t", "the", "aaaa", "        ", "😀", "\r\n"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(3000)]
    texts += ["", " ", "a" * 30_000, " " * 2000, "ab" * 5000, "漢" * 2000, "x y " * 1000]
    assert count_tokens(PATH, texts) == [len(ids) for ids in encoded(library, texts)]


def test_token_counts_of_odd_rows(library, odd, odd_rows, none):
    rows = token_counts(odd, PATH).collect()
    expected = sorted(
        (repr(doc), len((text or "").encode()), len(ids), len(ids) > 512)
        for (doc, text, _), ids in zip(odd_rows, encoded(library, [r[1] or "" for r in odd_rows]))
    )
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == expected
    assert token_counts(none, PATH).collect() == []


def test_hilbert_neighbours_touch():
    side = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = side[np.argsort(hilbert(side, 3))]
    assert sorted(hilbert(side, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def check_packing(rows, expected, capacity):
    """Every id once, sequences gapless and full but the last."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[(r.doc_id, r.doc_tokens)].append((r.start, ids.tolist()))
    for number, pieces in sequences.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == capacity or number == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    found = sorted((repr(doc), tuple(x for _, ids in sorted(pieces) for x in ids)) for (doc, _), pieces in docs.items())
    assert found == sorted((repr(doc), tuple(ids)) for doc, ids in expected)


def test_pack_odd_rows(library, odd, odd_rows, none, spark):
    rows = pack(odd, PATH).collect()
    assert sum(r.length for r in rows) == sum(len(ids) + 1 for ids in encoded(library, [r[1] or "" for r in odd_rows]))
    assert pack(none, PATH).collect() == []
    unique = {(i, text) for i, (_, text, _) in enumerate(odd_rows)}
    rows = pack(documents(spark, [(i, text) for i, text in unique]), PATH, capacity=64).collect()
    expected = [(i, [*ids, 1]) for (i, _), ids in zip(unique, encoded(library, [text or "" for _, text in unique]))]
    check_packing(rows, expected, 64)


def test_pack_puts_like_documents_together(spark):
    draw = random.Random(2)
    topics = [[f"t{k}x{i}" for i in range(30)] for k in range(4)]
    docs = [(i, " ".join(draw.choice(topics[i % 4]) for _ in range(100))) for i in range(80)]
    rows = pack(documents(spark, docs), PATH).collect()
    order = [r.doc_id % 4 for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert sum(a == b for a, b in zip(order, order[1:])) > 40  # about 20 by chance
