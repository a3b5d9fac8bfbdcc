"""Line dedup, mixing and sharding against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cinderlog.llm import lines, mixing, shuffling

from .conftest import documents


def distance(a, b):
    """Edit distance of word lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_decisions(rows, min_words=5):
    """(doc_id, line_no) -> keeper, for unique doc_ids."""
    occurrences, first = [], {}
    for doc, text in sorted(rows):
        for number, line in enumerate((text or "").split("\n") if text is not None else []):
            words = tuple(w.decode() for w in line.encode().split())
            occurrences.append(((doc, number), words))
            if words:
                first.setdefault(words, (doc, number))
    keeper = {}
    for words, place in first.items():
        long = [(other, p) for other, p in first.items() if len(other) >= min_words <= len(words)]
        earlier = [p for other, p in long if p < place and abs(len(other) - len(words)) <= 1 and distance(other, words) <= 1]
        keeper[words] = min(earlier, default=place)
    return {place: keeper.get(words, place) for place, words in occurrences}


def random_lines(seed, rows):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    pool = [[draw.choice(words) for _ in range(draw.choice([1, 2, 4, 5, 6, 9, 30]))] for _ in range(12)]
    out = []
    for doc in range(rows):
        text = []
        for _ in range(draw.randrange(5)):
            line = list(draw.choice(pool))
            for _ in range(draw.choice([0, 0, 1, 2])):
                at, kind = draw.randrange(len(line)), draw.randrange(3)
                line[at : at + (kind != 0)] = [draw.choice(words)] if kind < 2 else []
                line = line or ["w0"]
            text.append(draw.choice([" ", "  ", "\t"]).join(line))
        out.append((doc * 7 - 20, "\n".join(text)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_decisions_equal_brute_force(spark, seed):
    rows = random_lines(seed, 150) + [(5000, None), (5001, ""), (5002, "w1 " * 5000), (5003, "w1 " * 4999), (5004, "\n\n")]
    found = lines.line_decisions(documents(spark, rows)).collect()
    expected = plain_decisions(rows)
    assert {(r.doc_id, r.line_no): (r.keeper_doc_id, r.keeper_line_no) for r in found} == expected
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.keeper_doc_id, r.keeper_line_no)) for r in found)
    assert len(found) == len(expected)


def test_line_decisions_of_odd_rows(odd, odd_rows, none):
    found = lines.line_decisions(odd).collect()
    assert len(found) == sum(len(text.split("\n")) for _, text, _ in odd_rows if text is not None)
    prose = odd_rows[0][1]
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r.kept)
    assert by_doc[None] == [True]  # a null doc_id comes first
    assert by_doc[1] == [False, False] and by_doc[2] == [False] and by_doc[8] == [False, False] and by_doc[2**60 + 1] == [False]
    assert prose and lines.line_decisions(none).collect() == []


def test_without_repeats(spark, odd, none):
    rows = random_lines(3, 80) + [(900, None), (901, ""), (902, "short line\nkept here")]
    docs = documents(spark, rows)
    left = {r.doc_id: r for r in lines.without_repeats(docs, lines.line_decisions(docs)).collect()}
    keeper = plain_decisions(rows)
    for doc, text in rows:
        kept = [line for n, line in enumerate(text.split("\n")) if keeper[(doc, n)] == (doc, n)] if text is not None else None
        if text is None or kept == text.split("\n"):
            assert left[doc].text == text
        elif "".join(kept).strip():
            assert left[doc].text == "\n".join(kept) and left[doc].n_chars == len(left[doc].text)
        else:
            assert doc not in left
    cleaned = lines.without_repeats(odd, lines.line_decisions(odd))
    assert cleaned.columns == odd.columns and cleaned.count() > 0
    assert lines.without_repeats(none, lines.line_decisions(none)).collect() == []


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Share, cut what is above, share again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        above = {s for s in names if s not in full and target[s] >= most * sizes[s]}
        if not above:
            return target
        full |= above
        if len(full) == len(names):
            return {s: most * sizes[s] for s in names}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_its_targets(spark, seed):
    draw = random.Random(seed)
    rows = [(i, "w " * draw.choice([0, 1, 5, 80]), draw.choice(["a", "a", "a", "b", "ß", None, "d"])) for i in range(400)]
    quality = spark.createDataFrame([(i, draw.choice([0.5, 2.0])) for i in range(0, 400, 3)], "doc_id long, quality double")
    found = mixing.mix(documents(spark, rows), quality).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    target = plain_targets(sizes)
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    for source in sizes:
        assert abs(taken[source] - target[source]) <= largest[source] / 2 + 1e-6
    again = mixing.mix(documents(spark, rows).repartition(7), quality).collect()
    assert sorted(found, key=repr) == sorted(again, key=repr)


def test_better_documents_are_drawn_more_often(spark):
    rows = [(i, "w w w", "b") for i in range(600)] + [(1000 + i, "w w w", "a") for i in range(60)] + [(2000 + i, "w w w", "c") for i in range(600)]
    quality = spark.createDataFrame([(i, 4.0 if i % 2 else 1.0) for i in range(600)], "doc_id long, quality double")
    found = [r for r in mixing.mix(documents(spark, rows), quality).collect() if r.source == "b"]
    base = min(r.copies for r in found)
    better = Counter(r.doc_id % 2 for r in found if r.copies > base)
    assert better[1] > 1.3 * better[0]


def test_mix_and_take_odd_rows(odd, odd_rows, none):
    mixture = mixing.mix(odd).cache()
    assert mixture.count() == len(odd_rows)
    assert [r.copies for r in mixture.where("size = 0").collect()] is not None
    taken = mixing.take(odd, mixture)
    assert taken.columns == odd.columns
    assert taken.count() == sum(r.copies for r in mixture.collect())
    assert mixing.mix(none).collect() == [] and mixing.take(none, mixing.mix(none)).collect() == []


@pytest.mark.parametrize("bucket_bytes", [1 << 25, 2000])
def test_shuffle_writes_every_row_once(spark, bucket_bytes):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(803)]
    found = shuffling.shuffle_to_shards(documents(spark, rows), bucket_bytes=bucket_bytes).collect()
    assert sorted((r.doc_id, r.text) for r in found) == sorted(rows)
    shards = defaultdict(list)
    for r in found:
        shards[r.shard].append((r.slot, r.doc_id))
    assert sorted(shards) == list(range(8))
    assert {len(x) for x in shards.values()} <= {100, 101}
    for pieces in shards.values():
        order = [doc for _, doc in sorted(pieces)]
        assert [slot for slot, _ in sorted(pieces)] == list(range(len(pieces)))
        assert abs(sum(order) / len(order) - 401) < 110 and order != sorted(order)
    again = shuffling.shuffle_to_shards(documents(spark, rows).orderBy(F.desc("doc_id")), bucket_bytes=bucket_bytes).collect()
    assert sorted(found, key=repr) == sorted(again, key=repr)


def test_shuffle_odd_rows(odd, odd_rows, none):
    found = shuffling.shuffle_to_shards(odd).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == sorted(((d, t) for d, t, _ in odd_rows), key=repr)
    assert sorted(Counter(r.shard for r in found).values()) == [2] * 8
    assert shuffling.shuffle_to_shards(none).collect() == []
    with pytest.raises(ValueError, match="slot"):
        shuffling.shuffle_to_shards(odd, columns=("doc_id", "slot"))


def test_rows_alike_are_dealt_over_buckets(spark):
    """A third of all bytes are one row; it must not come together in one group, and every repeat has to be written."""
    rows = [(7, "same text")] * 500 + [(None, None)] * 3 + [(i, f"other {i}") for i in range(1000, 1500)]
    docs = documents(spark, rows)
    for bucket_bytes in (600, 1 << 20):
        found = shuffling.shuffle_to_shards(docs, bucket_bytes=bucket_bytes).collect()
        assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)
        shards = defaultdict(list)
        for r in found:
            shards[r.shard].append(r.slot)
        assert sorted(shards) == list(range(8)) and {len(x) for x in shards.values()} <= {125, 126}
        assert all(sorted(x) == list(range(len(x))) for x in shards.values())
        again = shuffling.shuffle_to_shards(docs.orderBy(F.desc("text")).repartition(5), bucket_bytes=bucket_bytes).collect()
        assert sorted(found, key=repr) == sorted(again, key=repr)
    spread = Counter(r.shard for r in shuffling.shuffle_to_shards(docs, bucket_bytes=600).collect() if r.doc_id == 7)
    assert len(spread) == 8


def test_rows_that_differ_in_a_carried_column_are_dealt_alike(spark):
    docs = documents(spark, [(1, "t", chr(97 + i % 26)) for i in range(200)])
    columns = ("doc_id", "text", "source")
    one = shuffling.shuffle_to_shards(docs, columns=columns).collect()
    two = shuffling.shuffle_to_shards(docs.orderBy(F.desc("source")), columns=columns).collect()
    assert sorted(one, key=repr) == sorted(two, key=repr)


def test_registered_shuffle_equals_plain_columns(spark, sf_dir):
    import zlib

    from cinderlog.llm.queries import op10_shuffle

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs)
    found = op10_shuffle(spark, sf_dir).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == expected
    assert {r.law for r in found} == {"rows"} and {r.grown_shard for r in found} == {None}
    counts = Counter(r.shard for r in found)
    assert sorted(counts) == list(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in found) == sorted((s, i) for s, n in counts.items() for i in range(n))
