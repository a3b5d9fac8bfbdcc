"""The registered queries and the pipeline over the test tables."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from check_oracle import oracle, rows_of
from tokenizers import Tokenizer

import __spark_entry__ as entry
from cinderlog.llm import quality
from cinderlog.llm.queries import QUERIES, llm_queries

from .test_lines_mixing_shuffling import plain_targets
from .test_near_copies import plain_components, plain_fingerprint

SQL = [query for query in QUERIES if query.sql]


@pytest.mark.parametrize("query", SQL, ids=[query.name for query in SQL])
def test_equals_sql(spark, sf_dir, query):
    frame = query(spark, sf_dir)
    mine = rows_of(frame.columns, frame.collect())
    cursor = oracle(sf_dir).execute(query.sql)
    theirs = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert mine[0] == theirs[0] and len(mine[1]) == len(theirs[1])
    for a, b in zip(mine[1], theirs[1]):
        assert all(math.isclose(x, y, rel_tol=1e-12) if isinstance(x, float) else x == y for x, y in zip(a, b))


def test_all_are_registered():
    assert set(llm_queries()) <= set(entry.queries())
    assert {name.split("_")[0] for name in llm_queries()} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}


def test_mixing_runs_no_python(spark, sf_dir):
    plan = llm_queries()["op6_mixing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        if name != "mixing":
            assert 0 < docs.count() <= before
            before = docs.count()
            assert docs.select("doc_id").distinct().count() == before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.where("start = 0").count() == docs.count()


def near(a, b):
    """At most one word changed, left out or put in."""
    if abs(len(a) - len(b)) > 1:
        return False
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    return a[head + 1 :] == b[head + 1 :] or a[head + 1 :] == b[head:] or a[head:] == b[head + 1 :]


def plain_fresh_lines(rows):
    first, kept = {}, {}
    for doc, text in sorted(rows):
        for number, line in enumerate(text.split("\n")):
            words = tuple(line.encode().split())
            if words:
                first.setdefault(words, (doc, number))
    long = {words: place for words, place in first.items() if len(words) >= 5}
    gone = {words for words, place in long.items() if any(p < place and near(other, words) for other, p in long.items())}
    for doc, text in rows:
        lines = []
        for number, line in enumerate(text.split("\n")):
            words = tuple(line.encode().split())
            if not words or (first[words] == (doc, number) and words not in gone):
                lines.append(line)
        if lines == text.split("\n") or "".join(lines).strip():
            kept[doc] = "\n".join(lines)
    return kept


def plain_copies(rows, quality):
    """How often each document is taken, drawn in Python."""
    sizes = {doc: len(text.encode().split()) for doc, text, _ in rows}
    source_size = Counter()
    for doc, _, source in rows:
        source_size[source] += sizes[doc]
    target = plain_targets(source_size)
    copies = {}
    for source in source_size:
        docs = [doc for doc, _, s in rows if s == source]
        draw = {doc: -math.log((int(hashlib.md5(f"mix:{doc}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / quality.get(doc, 1.0) for doc in docs}
        epochs = math.floor(target[source] / source_size[source])
        rest, through = target[source] - epochs * source_size[source], 0
        for doc in sorted(docs, key=lambda d: (draw[d], d)):
            through += sizes[doc]
            copies[doc] = epochs + (rest > 0 and 2 * through - sizes[doc] <= 2 * rest)
    return copies


def plain_near(rows):
    """The smallest doc_id that each document reaches over pairs of a Jaccard similarity of 0.8 or more, by sets of five words."""
    sets, holders = {}, {}
    for doc, text in rows:
        words = text.encode().lower().split()
        n = min(5, len(words))
        sets[doc] = frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()
        for shingle in sets[doc]:
            holders.setdefault(shingle, []).append(doc)
    root = {doc: doc for doc in sets}

    def find(doc):
        return doc if root[doc] == doc else find(root[doc])

    first = {}
    for doc, shingles in sorted(sets.items()):
        same = first.setdefault(shingles, doc)
        shared = Counter(other for shingle in shingles for other in holders[shingle] if other < doc) if same == doc else {}
        links = [other for other, n in shared.items() if n >= 0.8 * (len(shingles) + len(sets[other]) - n)]
        for other in [same, *links]:
            a, b = find(doc), find(other)
            root[max(a, b)] = min(a, b)
    return {doc: find(doc) for doc in sets}


def test_near_dedup_equals_jaccard_where_fingerprints_do_not(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.where("text is not null").collect()]
    expected = set(plain_near(rows).values())
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, table.where("text is not null"), "").collect()}
    assert kept == expected
    assert expected != {component for _, _, component in plain_components([(doc, plain_fingerprint(text)) for doc, text in rows])}


def test_pipeline_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["quality"](spark, table, sf_dir).cache()
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in quality.classify(table).where("keep").collect()}

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = stages["line_dedup"](spark, docs, sf_dir).cache()
    assert {r.doc_id: r.text for r in docs.collect()} == plain_fresh_lines(rows)
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    found = plain_near([(r.doc_id, r.text) for r in docs.collect()])
    docs = stages["near_dedup"](spark, docs, sf_dir).cache()
    assert {r.doc_id for r in docs.collect()} == set(found.values())

    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    labels = {}
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        labels[r.doc_id] = min(r.quality, labels.get(r.doc_id, r.quality))
    copies = plain_copies(rows, {doc: 2.0 if good else 0.5 for doc, good in labels.items()})
    docs = stages["mixing"](spark, docs, sf_dir).cache()
    assert Counter(r.doc_id for r in docs.collect()) == Counter({doc: n for doc, n in copies.items() if n})

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert sum(r.length for r in pieces) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r.doc_id for r in docs.collect())


def test_pipeline_on_no_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []


def test_nearest_query_reaches_its_recall(spark, sf_dir):
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids, matrix = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)])
    found = {}
    for r in llm_queries()["op1_nearest"](spark, sf_dir).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert math.isclose(r.score, float(rows[r.query_id] @ rows[r.vec_id]), rel_tol=1e-9)
    recall = []
    for query in ids[ids % 20 == 0]:
        scores = matrix @ rows[query]
        scores[ids == query] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        recall.append(len(found[query] & set(best.tolist())) / 20)
    assert np.mean(recall) >= 0.9
