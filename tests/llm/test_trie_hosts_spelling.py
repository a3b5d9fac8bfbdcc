"""Conversation trie, host rules and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderlog.llm import bytewords, hostrules, spelling, turntrie

from .conftest import clashing, documents

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """All columns of each node, sorted."""
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said[conv].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    said = {conv: [x[2] for x in sorted(turns, key=lambda x: x[:2])] for conv, turns in said.items()}
    members = defaultdict(list)
    whole = {}
    for conv, turns in said.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        whole[conv] = tuple(said.get(base, [])[:h] + turns[h:])
        for depth in range(len(whole[conv]) + 1):
            members[whole[conv][:depth]].append(conv)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        for depth in range(len(node) + 1):
            saved[node[:depth]] += (len(convs) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:depth]] += not children[node]
    return sorted(
        (
            (
                min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node], saved[node],
                hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node)).encode()).hexdigest(),
            )
            for node, convs in members.items()
        ),
        key=repr,
    )


def random_turns(seed):
    draw = random.Random(seed)
    rows = [(None, 1, "u", "x")] * 3
    for conv in draw.sample(range(-150, 400), 100):
        for turn in range(draw.choice([1, 2, 3, 3, 5, 9, 30])):
            rows.append((conv, draw.choice([turn, turn, turn, None]), draw.choice(["u", None, "u"]), draw.choice(["a", "bb", None, "", " é漢"])))
    rows += [(100, turn, "u", "a") for turn in range(120)] + [(draw.choice([7, 107]), 1, "u", "a") for _ in range(90)]
    return rows + [(conv, turn, "u", "a" * 500) for conv in (500, 501, 502, 600) for turn in range(64)]


@pytest.mark.parametrize("block_turns, shard_turns", [(32, 1 << 17), (32, 100), (4, 50)])
def test_trie_equals_brute_force(spark, block_turns, shard_turns):
    rows = random_turns(block_turns)
    table = clashing(spark.createDataFrame(rows, CONVERSATIONS)).withColumns({name: F.lit("x") for name in ("id", "chars", "depth", "block", "node")})
    found = turntrie.turn_trie(table.repartition(5), block_turns=block_turns, shard_turns=shard_turns).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_trie(rows)


def test_trie_of_few_rows(spark):
    for rows in ([], [(None, None, None, None)], [(7, None, None, None)], [(2**62, 1, "u", "x" * 200_000)] * 3):
        found = turntrie.turn_trie(spark.createDataFrame(rows, CONVERSATIONS)).collect()
        assert sorted((tuple(r) for r in found), key=repr) == plain_trie(rows)


@pytest.mark.parametrize("piece", [1, 7, 1 << 19])
def test_words_of_bytes(monkeypatch, piece):
    monkeypatch.setattr(bytewords, "PIECE", piece)
    draw = random.Random(piece)
    for _ in range(200):
        texts = [draw.choice([None, "".join(draw.choice("ab \t\né漢😀# \x0b\x85 ") for _ in range(draw.randrange(40)))]) for _ in range(draw.randrange(9))]
        column = pa.array(["skipped", *texts], pa.string())[1:]
        words = bytewords.ByteWords(column)
        expected = [(k, word.encode()) for k, text in enumerate(texts) for word in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        found = [(int(k), words.data[a:b].tobytes()) for k, a, b in zip(words.text_no, words.start, words.end)]
        assert found == expected
        assert len(set(zip(words.hash.tolist(), (w for _, w in found)))) == len({w for _, w in found}) == len(set(words.hash.tolist()))


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {k + i for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for i in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again), len(lines)


def test_host_rules_equal_brute_force(spark, odd, odd_rows, none):
    draw = random.Random(4)
    rows = list(odd_rows)
    for doc in range(400):
        host = draw.choice(["good", "good", "bad", None, f"h{draw.randrange(40)}"])
        words = [draw.choice(["#", "*|", "a"] if host == "bad" and draw.random() < 0.9 else ["alpha", "beta", "gamma", f"w{draw.randrange(99)}"]) for _ in range(draw.choice([3, 60, 200]))]
        rows.append((1000 + doc, draw.choice([" ", "\n"]).join(words), host))
    found = hostrules.judge(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
    expected = defaultdict(list)
    for doc, text, host in rows:
        n, chars, symbols, repeated, again, _ = plain_counts(text)
        expected[doc].append((n, chars, symbols, repeated, again, n < 50 or 100 * again > 50 * n, host))
    for doc, wanted in expected.items():
        got = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.host) for r in by_doc[doc]]
        assert sorted(got, key=repr) == sorted(wanted, key=repr)
    rate = {r.host: r.host_rate for r in found}
    assert rate["bad"] > 0.5 > rate["good"] and len({r.host_rate for r in found}) > 2
    assert all(r.kept == (not r.base_failed and r.host_rate <= 0.5) for r in found)
    assert hostrules.judge(odd).count() == len(odd_rows) and hostrules.judge(none).collect() == []


def test_hosts_of_few_documents_are_judged_by_the_rest():
    hosts = [(100, 5)] * 15 + [(100, 60)] * 2 + [(1, 1)]
    docs, failed = sum(n for n, _ in hosts), sum(f for _, f in hosts)
    a, strength = hostrules.prior(len(hosts), docs, float(sum(n * n for n, _ in hosts)), failed, sum(f * f / n for n, f in hosts))
    assert (1 + a) / (1 + strength) < 0.5 < (90 + a) / (100 + strength) and 1 < strength < 10
    assert hostrules.prior(0, 0, 0.0, 0, 0.0)[0] == 0.0 and hostrules.prior(1, 5, 25.0, 5, 5.0)[0] > 0


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_composed_automata_accept_all_pairs_once():
    draw = random.Random(5)
    for _ in range(300):
        n = draw.randrange(1, 7)
        words = {"".join(draw.choice("abcé"[: draw.randrange(2, 5)]) for _ in range(draw.choice([n, n + 1]))) for _ in range(draw.randrange(1, 30))}
        found = [frozenset(pair) for pair in spelling.near_pairs(list(words), n, 0, 0, 0, False)]
        expected = {frozenset((a, b)) for a in words for b in words if min(len(a), len(b)) == n and one_edit(a, b)}
        assert len(found) == len(set(found)) and set(found) == expected


def test_acceptor_is_minimal_and_numbers_its_strings():
    words = sorted({f"{a}{b}{c}" for a in "abc" for b in "de" for c in "fg"})
    automaton = spelling.Acceptor(words)
    assert len(automaton.arcs) == 4 and automaton.size[automaton.start] == len(words)
    for number, word in enumerate(words):
        state, total = automaton.start, 0
        for letter in word:
            state, step = automaton.arcs[state][letter]
            total += step
        assert automaton.final[state] and total == number


def plain_variants(rows, min_chars):
    uses = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            number = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if number % 31 == 0:
                word = word[: number % len(word)] + word[number % len(word) + 1 :]
            if len(word) >= min_chars:
                uses[word] += 1
    uses = {word: n for word, n in uses.items() if n >= 2}
    form, near = {}, {}
    for word, n in uses.items():
        near[word] = [other for other in uses if one_edit(word, other)]
        best = min(near[word], key=lambda other: (-uses[other], other), default=None)
        form[word] = best if best is not None and uses[best] >= 10 * n else None

    def root(word):
        return word if form[word] is None else root(form[word])

    return {word: (n, len(near[word]), form[word], uses.get(form[word]), root(word)) for word, n in uses.items()}


@pytest.mark.parametrize("min_chars, group_words", [(7, 1 << 14), (3, 2), (1, 3)])
def test_variants_equal_brute_force(spark, min_chars, group_words):
    draw = random.Random(min_chars)
    pool = ["".join(draw.choice("abcÀÉé") for _ in range(draw.randrange(1, 10))) for _ in range(60)]
    rows = [(1000, "x" * 3000 + " " + "x" * 2999 + "\n" + "x" * 3000 + "漢" + "x" * 2999), (1001, ""), (None, None)]
    for doc in range(300):
        words = []
        for _ in range(draw.randrange(40)):
            word = pool[min(int(draw.expovariate(0.3)), 59)]
            at = draw.randrange(len(word))
            words.append(word if draw.random() < 0.9 else word[:at] + draw.choice("abcÀÉé") + word[at + draw.randrange(2) :])
        rows.append((doc if doc % 17 else None, " ".join(words)))
    found = spelling.spelling_variants(documents(spark, rows), min_chars=min_chars, group_words=group_words).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == plain_variants(rows, min_chars)
    assert len(found) == len({r.word for r in found})


def test_variants_of_odd_rows(odd, odd_rows, none):
    found = spelling.spelling_variants(odd, min_chars=2).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == plain_variants([(d, t) for d, t, _ in odd_rows], 2)
    assert spelling.spelling_variants(none).collect() == []
    with pytest.raises(ValueError, match="ratio"):
        spelling.spelling_variants(none, ratio=2)
