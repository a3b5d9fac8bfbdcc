"""Similarity fingerprints, minwise fingerprints and their groups against brute force."""

import hashlib
import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from cinderlog.llm import minhash, simhash
from cinderlog.llm.common import group_roots
from cinderlog.llm.components import components

from .conftest import documents


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, max_bits=2):
    """Smallest doc_id reachable, for (doc_id, fingerprint) rows."""
    values = sorted(set(f for _, f in prints))
    pairs = [(i, j) for i, j in combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= max_bits]
    root = group_roots(len(values), np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
    of = {value: root[i] for i, value in enumerate(values)}
    least = {}
    for doc, value in prints:
        if doc is not None:
            least[of[value]] = min(doc, least.get(of[value], doc))
    return sorted((repr(doc), f"{value:016x}", least.get(of[value])) for doc, value in prints)


def clusters(seed, rows):
    draw = random.Random(seed)
    out = []
    while len(out) < rows:
        centre = draw.getrandbits(64)
        for _ in range(draw.choice([1, 2, 5, 40])):
            centre ^= sum(1 << draw.randrange(64) for _ in range(draw.randrange(4)))
            out.append(centre)
    return out[:rows]


@pytest.mark.parametrize("same", [True, False])
def test_trie_traversal_finds_all_pairs(same):
    a, b = (np.unique(np.array(clusters(seed, 900), np.uint64)) for seed in (1, 2))
    b = a if same else np.union1d(b, a[::3] ^ np.uint64(5))
    found = {(int(i), int(j)) for x, y in simhash.near_pairs(a, b, same) for i, j in zip(x, y)}
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= 2
    expected = {(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if not same or i < j}
    assert found == expected


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(1000, 1001 + i) for i in range(300)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = group_roots(1400, np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    expected = {x: int(root[x]) for e in edges for x in e if e[0] != e[1]}
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("leaf_rows", [1 << 14, 64, 8])
def test_fingerprint_components_for_every_leaf_size(spark, leaf_rows):
    values = sorted({x - (1 << 64) if x >> 63 else x for x in clusters(7, 700)})
    found = dict(simhash.fingerprint_components(spark.createDataFrame([(v,) for v in values], "fp long"), leaf_rows).collect())
    unsigned = np.array(values, np.int64).view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= 2)
    root = group_roots(len(values), i, j)
    linked = {values[x] for x, y in zip(i, j) if x != y}
    assert found == {v: values[root[k]] for k, v in enumerate(values) if v in linked}


def test_simhash_groups_of_odd_rows(odd, odd_rows, none):
    found = sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_groups(odd).collect())
    assert found == plain_components([(doc, plain_fingerprint(text)) for doc, text, _ in odd_rows])
    assert simhash.simhash_groups(none).collect() == []


def test_one_of_each(odd, odd_rows):
    groups = simhash.simhash_groups(odd)
    kept = [r.doc_id for r in simhash.one_of_each(odd, groups).collect()]
    components_of = {r.component_id for r in groups.collect()}
    assert sorted(k for k in kept if k is not None) == sorted(c for c in components_of if c is not None)
    assert kept.count(None) == sum(r[0] is None for r in odd_rows)


def test_signatures_estimate_jaccard():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [draw.choice(words) for _ in range(1500)]
    sign = minhash.Signer(256)
    for share in (0.02, 0.1, 0.3):
        other = [draw.choice(words) if draw.random() < share else w for w in base]
        a, b = (set(sign.shingles(" ".join(x)).tolist()) for x in (base, other))
        assert abs(minhash.alike(sign(" ".join(base)), sign(" ".join(other))) - len(a & b) / len(a | b)) < 0.1


def test_edit_likeness(spark, odd, odd_rows, none):
    for frame, rows in ((odd, odd_rows), (documents(spark, [(i * 3, f"text {i} " * i) for i in range(200)]), [(i * 3, f"text {i} " * i, "") for i in range(200)])):
        found = sorted(minhash.edit_likeness(frame).collect(), key=repr)
        order = sorted(((doc, text or "") for doc, text, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
        expected = []
        for (doc, text), (_, other) in zip(order, order[1:] + order[:1]):
            half = len(text) // 2
            edited = text[: len(text) - half] + other[:half]
            expected.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest()))
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=repr) == sorted(expected, key=repr)
        sign = minhash.Signer()
        texts = {hashlib.sha256((text or "").encode()).hexdigest(): text or "" for _, text, _ in rows}
        for r in found:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            if r.edited_sha256 in texts:
                assert r.edited_fingerprint == minhash.printed(sign(texts[r.edited_sha256]))
    lone = minhash.edit_likeness(documents(spark, [(4, "a b c d e f")])).collect()
    assert [(r.doc_id, r.near_next) for r in lone] == [(4, 1.0)]
    assert minhash.edit_likeness(none).collect() == []


@pytest.mark.parametrize("block_rows", [512, 3])
def test_near_duplicates(spark, block_rows):
    draw = random.Random(6)
    texts = []
    for group in range(12):
        base = [f"g{group}w{draw.randrange(400)}" for _ in range(120)]
        for _ in range(draw.choice([1, 3, 9])):
            texts.append(" ".join(base[:k] + ["changed"] + base[k + 1 :] if draw.random() < 0.8 else base) if (k := draw.randrange(120)) >= 0 else "")
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, texts[0].upper()), (None, texts[0]), (0, texts[0])]
    found = sorted((repr(r.doc_id), r.class_id) for r in minhash.near_duplicates(documents(spark, rows), block_rows=block_rows).collect())
    sign = minhash.Signer()
    sets = [frozenset(sign.shingles(t or "").tolist()) for _, t in rows]
    pairs = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = group_roots(len(rows), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root[k]] = min(doc, least.get(root[k], doc))
    assert found == sorted((repr(doc), least[root[k]]) for k, (doc, _) in enumerate(rows))


def test_near_duplicates_of_odd_rows(odd, odd_rows, none):
    assert minhash.near_duplicates(odd).count() == len(odd_rows)
    assert minhash.near_duplicates(none).collect() == []


def five_word_sets(rows):
    return [frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in ((text or "").lower().split() for _, text in rows)]


def edited(seed):
    """Texts of which pairs lie on both sides of a likeness of 0.8, by words changed here and there."""
    draw = random.Random(seed)
    rows = []
    for group in range(25):
        base = [f"g{group}w{draw.randrange(500)}" for _ in range(200)]
        for changes in (0, 1, 3, 4, 4, 5, 9):
            words = list(base)
            for at in draw.sample(range(200), changes):
                words[at] = f"new{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_stage_keeps_one_of_each_five_word_group(spark):
    rows = edited(8)
    sets = five_word_sets(rows)
    pairs = [(i, j) for i, j in combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = group_roots(len(rows), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.tolist()))


def test_stage_judges_rows_of_one_doc_id_and_of_none_by_their_texts(spark):
    prose, other = (" ".join(f"{name}{i}" for i in range(60)) for name in "pq")
    rows = [(1, prose), (2, prose), (2, other), (None, prose), (None, other + " more"), (None, "three more words"), (None, "Three  more words"), (5, other), (5, other)]
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, documents(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text.lower().split()[0]) for r in kept), key=repr) == [(1, "p0"), (2, "q0"), (None, "three")]


def test_large_groups_need_no_block_pairs(spark, monkeypatch):
    draw = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(240) if (k := draw.randrange(400)) >= 0]
    asked = []
    write = minhash.written

    def counted(df, name):
        out = write(df, name)
        if name == "compared":
            asked.append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", counted)
    found = minhash.near_duplicates(documents(spark, rows), block_rows=8).collect()
    assert {r.class_id for r in found} == {0}
    assert 0 < sum(asked) < 16 * 3 * 2 * len(rows)


@pytest.mark.parametrize("leaf_rows", [1 << 14, 20])
def test_tries_bring_together_what_five_words_share(spark, leaf_rows):
    rows = edited(12) + [(1000, "a b c d e f g h"), (1001, "a b c d e f g h i"), (1002, "p q r"), (1003, "p q")]
    sign = minhash.Signer()
    sets = [np.unique(sign.shingles(text)) for _, text in rows]
    prints = spark.createDataFrame([(i, simhash.wide_fingerprint(one).tolist()) for i, one in enumerate(sets)], "content long, marks array<long>")
    groups = {}
    for r in simhash.near_groups(prints, 0.8, leaf_rows).collect():
        groups.setdefault((r.band, r.key), set()).add(r.content)
    together = {pair for group in groups.values() for pair in combinations(sorted(group), 2)}
    alike = {(i, j) for i, j in combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert alike <= together and len(together) < 2 * len(rows) * 7
    assert len({band for band, _ in groups}) > (1 if leaf_rows == 20 else 0)


def test_stage_finds_near_copies_by_fingerprints(spark, monkeypatch):
    asked, search = [], simhash.near_groups
    monkeypatch.setattr(simhash, "near_groups", lambda prints, *rest: asked.append(prints.count()) or search(prints, *rest))
    monkeypatch.setattr(minhash, "near_duplicates", None)
    rows = edited(8)[:14]
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, documents(spark, rows), "").collect()
    assert asked == [14 - len(rows) + len({text for _, text in rows})] and len(kept) < len(rows)


def test_a_node_of_very_many_near_copies_is_dealt_over_blocks(spark):
    draw = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(200) if (k := draw.randrange(400)) >= 0]
    rows += [(500, "some other text of eight words or so")]
    assert sorted(r.doc_id for r in simhash.one_of_near_copies(documents(spark, rows), leaf_rows=16).collect()) == [0, 500]


def test_a_large_group_that_no_representative_gathers_is_compared_once(spark, monkeypatch):
    n, bands, block_rows = 120, 3, 8
    sets = [np.unique(minhash.Signer().shingles(" ".join(f"w{j}" for j in range(8 * i, 8 * i + 100)))) for i in range(n)]
    contents = [minhash._content(one) for one in sets]
    rows = [(content, len(one), band, 7) for band in range(bands) for content, one in zip(contents, sets)]
    members = spark.createDataFrame(rows, "content long, size long, band int, key long")
    table = spark.createDataFrame([(c, one.view(np.int64).tolist()) for c, one in zip(contents, sets)], "content long, shingles array<long>")
    asked, write = {}, minhash.written

    def counted(df, name):
        out = write(df, name)
        asked[name] = asked.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "written", counted)
    links = minhash._links(spark, members, table, 0.8, block_rows)
    assert dict(components(links).collect()) == {content: min(contents) for content in contents}  # each is alike to the next only
    assert asked["compared"] < bands * n * (n // block_rows + 4)
    assert asked["group-states"] <= 2 * len(rows)


def test_sets_of_unlike_sizes_are_no_candidates(spark):
    marks = simhash.wide_fingerprint(np.unique(minhash.Signer().shingles(" ".join(f"w{i}" for i in range(50))))).tolist()
    prints = spark.createDataFrame([(1, 100, marks), (2, 79, marks), (3, 80, marks), (4, 60, marks), (5, 75, marks)], "content long, size long, marks array<long>")
    groups = {}
    for r in simhash.near_groups(prints.where("content <> 5"), 0.8).collect():
        groups.setdefault((r.band, r.key), set()).add((r.content, r["size"]))
    assert set(map(frozenset, groups.values())) == {frozenset({(1, 100), (2, 79), (3, 80)})}
