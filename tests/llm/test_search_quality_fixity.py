"""Nearest neighbours, the quality classifier and the fixity audit."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.llm import fixity, nearest, quality

from .conftest import clashing, documents


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")


def exact(rows, queries, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = tuple(np.float32(x) for x in v)
            usable[i] = min(usable.get(i, v), v)
    out = {}
    for q in usable:
        if queries(q):
            scores = [(-float(np.dot(np.float64(usable[q]), np.float64(v))), i) for i, v in usable.items() if i != q and len(v) == len(usable[q])]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_probes_come_in_order_of_cost():
    place = np.array([0.1, 3.45, -2.8])
    cells = nearest.probe_cells(place, 27)
    assert len({tuple(c) for c in cells}) == 27
    inside = place - np.floor(place)
    step = cells - np.floor(place)
    cost = (np.where(step < 0, inside**2, 0) + np.where(step > 0, (1 - inside) ** 2, 0)).sum(axis=1)
    assert (np.diff(cost) >= -1e-12).all()


def test_probes_needed_are_places_in_that_order():
    draw = np.random.default_rng(4)
    hashing = nearest.Hashing(6, 3.0, 0.7, 40, 4, 3)
    queries, points = draw.standard_normal((5, 6)), draw.standard_normal((80, 6)) * 0.5
    cells = np.floor(hashing.places(points, query=False))
    for needed, probed in zip(nearest.probes_needed(hashing, queries, [cells] * 5), hashing.probed(queries)):
        for table, visited in enumerate(probed):
            at = {tuple(cell): i for i, cell in enumerate(visited, 1)}
            assert needed[:, table].tolist() == [at.get(tuple(cell), 41) for cell in cells[:, table]]


def searched(x, hashing, queries):
    """For each query row which vectors its buckets hold."""
    keys = hashing.keys(np.floor(hashing.places(x, query=False)))
    return np.array([np.any([np.isin(keys[:, t], hashing.keys(cells)) for t, cells in enumerate(tables)], axis=0) for tables in hashing.probed(x[queries])])


def nearest_rows(x, queries, k=20):
    scores = x[queries] @ x.T
    scores[np.arange(len(queries)), queries] = -np.inf
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def test_fit_is_selective_where_vectors_have_contrast():
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((500, 48))
    x = centres[draw.integers(0, 500, 50_000)] + 0.25 * draw.standard_normal((50_000, 48))
    near = nearest_rows(x, np.arange(64))
    hashing = nearest.fitted(x[:64], [x[rows] for rows in near], x[:2000], float(np.linalg.norm(x, axis=1).max()), len(x))
    queries = np.arange(2000, 2100)
    visited = searched(x, hashing, queries)
    assert np.take_along_axis(visited, nearest_rows(x, queries), 1).mean() >= 0.9
    assert visited.mean() <= 0.2


def test_fit_refuses_what_it_cannot_find(spark, monkeypatch):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((300, 16))
    near = [x[rows] for rows in nearest_rows(x, np.arange(20))]
    monkeypatch.setattr(nearest, "FUNCTIONS", (12,))
    monkeypatch.setattr(nearest, "MOST_PROBES", 2)
    assert nearest.fitted(x[:20], near, x, float(np.linalg.norm(x, axis=1).max()), 300) is None
    # Then all vectors are searched.
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = nearest.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, block_rows=90).collect()
    expected = exact(rows, lambda i: i % 50 == 0, 20)
    got = {q: [i for i, _ in expected[q]] for q in expected}
    assert {q: [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in got} == got


def test_nearest_finds_most_neighbours(spark):
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((30, 32))
    x = centres[draw.integers(0, 30, 3000)] + 0.5 * draw.standard_normal((3000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x * draw.uniform(0.5, 2, (3000, 1)))]
    found = nearest.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, block_rows=700).collect()
    expected = exact(rows, lambda i: i % 50 == 0, 20)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(expected) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / 20 for q in expected])
    assert recall >= 0.9
    for neighbours in got.values():
        assert [s for _, s in neighbours] == sorted((s for _, s in neighbours), reverse=True)


def test_nearest_with_copies_and_odd_vectors(spark):
    """A third are copies; few enough in all that every query's answer has to be exact."""
    draw = random.Random(2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(30)] + [(100 + i, [draw.gauss(0, 1) for _ in range(3)]) for i in range(12)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [None, 1.0, 1.0]), (203, [float("nan"), 1.0, 1.0]), (204, [float("inf"), 1.0, 0.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (300, [1.0, 1.0]), (301, [2.0, 1.0]), (302, []), (5, [1.0, 2.0, 3.0]), (101, [9.0, 9.0, 9.0])]
    found = nearest.nearest(clashing(vectors(spark, rows)), F.col("vec_id") % 5 == 0).collect()
    expected = exact(rows, lambda i: i % 5 == 0, 20)
    got = {q: [] for q in expected}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in expected.items()}
    for q in (0, 5, 10, 300):
        assert [i for i, _ in got[q]] == [i for i, _ in expected[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in expected[q]])
    assert nearest.nearest(vectors(spark, []), F.col("vec_id") % 5 == 0).collect() == []


def test_classifier_on_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = quality.classify(docs).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")), "doc_id")
    rows = scored.collect()
    assert np.mean([r.keep == bool(r.label) for r in rows]) > 0.95
    assert np.mean([r.keep for r in rows if r.label == 1]) > 0.97
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {r.doc_id for r in quality.classify(docs).where("keep").collect()}


def test_classifier_of_odd_rows(odd, odd_rows, none):
    found = quality.classify(odd).collect()
    assert len(found) == len(odd_rows)
    assert not any(r.keep for r in found if r.doc_id in (3, 4, 5))
    assert quality.classify(none).collect() == []
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(none).collect() == []


def test_estimation_learns_who_is_right():
    draw = np.random.default_rng(3)
    truth = draw.random(4000) < 0.8
    rows = []
    for good in truth:
        row = []
        for alarm, false in ((0.6, 0.02), (0.5, 0.02), (0.7, 0.05), (0.1, 0.1)):
            row.append("0" if draw.random() < (false if good else alarm) else "1")
        rows.append("".join(row))
    patterns, counts = np.unique(rows, return_counts=True)
    model = quality.estimate(patterns.tolist(), counts.astype(float))
    belief = dict(zip(patterns, model.posterior(patterns.tolist())))
    assert np.mean([(belief[r] > 0.5) == t for r, t in zip(rows, truth)]) > 0.9
    assert model.rates[0, 0, 0] > 0.4 > 0.2 > model.rates[3, 0, 0]


def records(spark, rows):
    return clashing(spark.createDataFrame(rows, "warc_file int, offset long, length long, digest string"))


def test_audit_locates_every_difference(spark):
    draw = random.Random(4)
    first = [(f, at * 1000, 1000, f"{draw.getrandbits(64):x}") for f in range(5) for at in range(draw.choice([1, 40, 900]))]
    second, expected = [], set()
    for row in first:
        dice = draw.random()
        if dice < 0.01:
            expected.add((row[0], row[1], "missing"))
            continue
        if dice < 0.02:
            expected.add((row[0], row[1], "changed"))
            row = (*row[:3], row[3] + "!") if dice < 0.015 else (row[0], row[1], row[2] + 1, row[3])
        second.append(row)
    second += [(2, 5_000_000, 10, "new"), (9, 0, 10, "new file")]
    expected |= {(2, 5_000_000, "extra"), (9, 0, "extra")}
    found = fixity.audit(records(spark, first), records(spark, second))
    assert {(r.warc_file, r.offset, r.status) for r in found.collect()} == expected
    assert fixity.audit(records(spark, first), records(spark, first)).collect() == []
    assert fixity.audit(records(spark, []), records(spark, [])).collect() == []
    assert fixity.audit(records(spark, []), records(spark, first[:3] + first[:3])).count() == 3
    nulls = [(None, 0, 1, "a"), (1, None, 1, "a"), (1, 5, None, "a"), (1, 5, 1, None)]
    assert fixity.audit(records(spark, nulls), records(spark, first[:1])).count() == 1


def test_records_of_pages(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, None, None), (None, "u", "h"), (1, "http://a", "<p>é</p>"), (3, "x" * 5000, "")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = fixity.warc_records(pages, files=1).orderBy("offset").collect()
    at = 0
    for r in found:
        assert r.offset == at
        at += r.length
    assert len(found) == len(rows)
    assert fixity.warc_records(pages.limit(0)).collect() == []


def test_large_files_get_more_levels(spark):
    """Six files of 64 MiB records, one of them beyond 5 GiB: no node has more than `fan` children."""
    big = [(0, at << 26, 1 << 26, f"{at:x}") for at in range(90)] + [(f, 0, 10, "a") for f in range(1, 6)]
    size = 90 << 26
    levels = fixity.levels_for(size)
    assert fixity.levels_for(1 << 32) < levels and fixity.levels_for(0) == 2 == fixity.levels_for(1 << 20) and fixity.levels_for((1 << 20) + 1) == 3
    built = fixity.tree(records(spark, big), levels)
    nodes = [[r.node for r in level.where("warc_file = 0").collect()] for level in built]
    assert nodes[-1] == [0]
    for low, high in zip(nodes, nodes[1:-1]):
        assert set(high) == {n // fixity.FAN for n in low}
    assert len(nodes[-2]) <= fixity.FAN
    worse = [(0, 77 << 26, 1 << 26, "?") if row[:2] == (0, 77 << 26) else row for row in big]
    assert [(r.warc_file, r.offset, r.status) for r in fixity.audit(records(spark, big), records(spark, worse)).collect()] == [(0, 77 << 26, "changed")]


def test_second_copy_is_damaged_in_its_bytes(spark):
    from cinderlog.llm.queries import damaged

    pages = spark.createDataFrame([(i, f"http://{i}", f"<p>é {i}</p>" * 9) for i in range(1500)], "page_id long, url string, html string")
    kept = fixity.archived(pages, 64)
    first = {}
    for r in kept.collect():
        first.setdefault((r.warc_file, r.page_id), []).append(r.record)
    second = {}
    for r in damaged(kept).collect():
        second.setdefault((r.warc_file, r.page_id), []).append(r.record)
    lost = [k for k in first if k not in second]
    longer = [k for k in second if len(second[k]) > 1]
    flipped = [k for k in second if len(second[k]) == 1 and second[k] != first[k] and len(second[k][0]) == len(first[k][0])]
    cut = [k for k in second if len(second[k]) == 1 and 2 * len(second[k][0]) // 2 <= len(first[k][0]) // 2]
    assert lost and longer and flipped and cut
    assert all(f % 16 == 0 for f, _ in lost + longer + cut)
    found = fixity.audit(fixity.laid_out(kept), fixity.laid_out(damaged(kept))).collect()
    assert {r.status for r in found} == {"changed", "missing", "extra"}
    assert {r.warc_file for r in found} == {f for f, _ in lost + longer + cut + flipped}


def test_documents_fixture(spark):
    assert documents(spark, [(1, "a")]).columns[:2] == ["doc_id", "text"]


def test_copies_of_a_row_reach_the_driver_once(spark, monkeypatch):
    from cinderlog.llm import quality

    prose = "The quick brown fox jumps over the lazy dog and then it runs away from all of them."
    docs = documents(spark, [(1, prose)] * 300 + [(i, f"{prose} {i}") for i in range(2, 20)])
    kind, sizes = type(docs), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (rows := collect(self), "slots" in self.columns and sizes.append(len(rows)))[0])
    quality.ready(spark)
    quality.fit(docs, sample_rows=50)
    assert sizes == [19]
