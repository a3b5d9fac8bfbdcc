"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.common import ready
from cinderlog.sources.workspace import written

NEIGHBOURS, BLOCK_BYTES, QUERY_ROWS, SAMPLE_ROWS, SAMPLE_QUERIES, RECALL, SEED = 20, 16 << 20, 1 << 12, 2000, 64, 0.95, 1
#: Tables, and what the fit chooses from: functions of a table, widths in median distances of near neighbours, probes.
TABLES, FUNCTIONS, WIDTHS, MOST_PROBES = 8, (6, 8, 10, 12), (1.0, 1.6), 512
#: What visiting a bucket costs, in vectors scored, for each unit of the square root of the table's vectors: buckets
#: visited by a query may grow as that root does, as long as the vectors scored fall by more.
PROBE_COST = 0.15
#: Queries that are scored against a bucket at once.
_CHUNK = 512


@dataclass(frozen=True)
class Hashing:
    """p-stable hash functions of one dimension: floor((a.x + b) / width), `functions` of them to a table's bucket.

    Inner products become distances by one more coordinate (Bachrach et al.): x goes to (x / most, sqrt(1 - |x|^2 /
    most^2)) and a query q to (q / |q|, 0); the nearest are then those of largest inner product.
    """

    dimension: int
    most: float
    width: float
    probes: int
    functions: int
    tables: int = TABLES

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Each table draws its own."""
        draws = [np.random.default_rng([SEED, self.dimension, table]) for table in range(self.tables)]
        lines = np.stack([draw.standard_normal((self.functions, self.dimension + 1)) for draw in draws])
        return lines, np.stack([draw.random(self.functions) for draw in draws])

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Projections in units of the width: (rows, tables, functions)."""
        squares = np.einsum("ij,ij->i", x, x)
        if query:
            raised = np.c_[x / np.sqrt(squares)[:, None], np.zeros(len(x))]
        else:
            raised = np.c_[x / self.most, np.sqrt(np.maximum(0.0, 1 - squares / self.most**2))]
        lines, shifts = self._lines()
        return np.tensordot(raised, lines, axes=(1, 2)) / self.width + shifts

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """64-bit numbers of buckets: (..., functions) integers to (...)."""
        flat = np.ascontiguousarray(cells.reshape(-1, self.functions).astype("<i4"))
        keys = np.array([xxhash.xxh64_intdigest(row.tobytes(), self.dimension) for row in flat], np.uint64)
        return keys.view(np.int64).reshape(cells.shape[:-1])

    def probed(self, x: np.ndarray) -> list[list[np.ndarray]]:
        """For each query and table the cells to visit, most promising first."""
        places = self.places(x, query=True)
        return [[probe_cells(row, self.probes) for row in rows] for rows in places]


def probe_cells(place: np.ndarray, probes: int) -> np.ndarray:
    """Cells around a place in the order of estimated success: the sum of squared distances to the crossed sides.

    Steps over sides are sorted by distance; sets of steps are drawn from a heap by `shift` and `expand` (Lv et al.),
    leaving out those that step both ways in one coordinate.
    """
    home = np.floor(place)
    inside = place - home
    n = len(place)
    costs = np.concatenate([inside**2, (1 - inside) ** 2])
    order = np.argsort(costs, kind="stable")
    cost = costs[order]
    cells, heap = [home], [(cost[0], (0,))]
    while heap and len(cells) < probes:
        score, steps = heapq.heappop(heap)
        chosen = order[list(steps)]
        axes = chosen % n
        if len(set(axes.tolist())) == len(axes):
            cell = home.copy()
            cell[axes] += np.where(chosen < n, -1, 1)
            cells.append(cell)
        last = steps[-1]
        if last + 1 < 2 * n:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*steps[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*steps, last + 1)))
    return np.array(cells)


def cheapest_scores(costs: np.ndarray, most: int) -> np.ndarray:
    """The `most` smallest scores of sets of steps, ascending. costs: (rows, functions, 2), those of the two sides."""
    found = np.zeros((len(costs), 1))
    for axis in range(costs.shape[1]):
        found = np.concatenate([found, found + costs[:, axis, :1], found + costs[:, axis, 1:]], axis=1)
        if found.shape[1] > most:
            found = np.partition(found, most - 1, axis=1)[:, :most]
    return np.sort(found, axis=1)


def probes_needed(hashing: Hashing, queries: np.ndarray, points: list[np.ndarray]) -> list[np.ndarray]:
    """For each query, how many probes of each table reach each of its points (points, tables); above hashing.probes: more."""
    places = hashing.places(queries, query=True)
    home = np.floor(places)
    inside = places - home
    costs = np.stack([inside**2, (1 - inside) ** 2], axis=-1)
    scores = cheapest_scores(costs.reshape(-1, hashing.functions, 2), hashing.probes).reshape(len(queries), hashing.tables, -1)
    needed = []
    for i, own in enumerate(points):
        step = own - home[i]
        score = np.where(step < 0, costs[i, ..., 0], np.where(step > 0, costs[i, ..., 1], 0.0)).sum(axis=-1)
        # Sums in another order differ in their last bits.
        ranks = np.stack([np.searchsorted(scores[i, t], score[:, t] * (1 + 1e-9) + 1e-12) for t in range(hashing.tables)], axis=1)
        beyond = (np.abs(step).max(axis=-1) > 1) | (score > scores[i, :, -1] * (1 + 1e-9) + 1e-12)
        needed.append(np.where(beyond, hashing.probes + 1, np.maximum(ranks, 1)))
    return needed


def fitted(queries: np.ndarray, neighbours: list[np.ndarray], sample: np.ndarray, most: float, total: int, recall: float = RECALL) -> Hashing | None:
    """Functions, width and probes together, for one dimension with `total` vectors: the cheapest that find enough.

    neighbours: the exact nearest of each of the queries in the whole table. A choice counts if it finds `recall` of
    them; its cost is what a query scores in all tables, estimated on the sample, and what visiting its buckets costs.
    None if no choice with up to MOST_PROBES probes finds enough.
    """
    dimension = sample.shape[1]
    unit = queries / np.linalg.norm(queries, axis=1)[:, None]
    near = np.concatenate([n @ q for q, n in zip(unit, neighbours)]) / most if neighbours else np.zeros(0)
    if not len(near):
        return Hashing(dimension, most, 1.0, 1, 1, 1)
    distance = float(np.median(np.sqrt(np.maximum(0.0, 2 - 2 * near))))
    best, least = None, np.inf
    for functions in FUNCTIONS:
        for factor in WIDTHS:
            hashing = Hashing(dimension, most, max(1e-6, factor * distance), min(3**functions, MOST_PROBES), functions, TABLES)
            cells = np.floor(hashing.places(sample, query=False))
            reach = np.stack(probes_needed(hashing, queries, [cells] * len(queries)))
            found = np.concatenate(probes_needed(hashing, queries, [np.floor(hashing.places(n, query=False)) for n in neighbours]))
            probes = int(np.quantile(found.min(axis=1), recall, method="higher"))
            if probes <= hashing.probes:
                cost = total * float((reach <= probes).sum(axis=2).mean()) + PROBE_COST * np.sqrt(total) * probes * TABLES
                if cost < least:
                    best, least = replace(hashing, probes=probes), cost
    return best


def usable(embedding: Column) -> Column:
    """Neither null nor zero, and without components that are null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _by_dimension(batch: pa.RecordBatch):
    sizes = np.array(batch["vector"].value_lengths())
    for size in np.unique(sizes):
        yield int(size), batch.take(pa.array(np.flatnonzero(sizes == size)))


def _exact_neighbours(classes: DataFrame, ids: list[int], queries: np.ndarray, keep: int) -> list[np.ndarray]:
    """The vectors of the `keep` nearest classes of a few queries: every task hands on its best, the driver gets keep per query."""
    own = np.array(ids, np.int64)

    def best(batches):
        seen, scores = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0))
        for batch in batches:
            found = queries @ _matrix(batch["vector"]).T
            named = batch["class_id"].to_numpy()
            found[own[:, None] == named[None, :]] = -np.inf
            scores, seen = np.hstack([scores, found]), np.hstack([seen, np.broadcast_to(named, found.shape)])
            order = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
            scores, seen = np.take_along_axis(scores, order, 1), np.take_along_axis(seen, order, 1)
        numbers = np.repeat(np.arange(len(own)), scores.shape[1])
        kept = np.isfinite(scores.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(numbers[kept]), pa.array(seen.ravel()[kept]), pa.array(scores.ravel()[kept])], ["number", "class_id", "score"])

    rows = classes.select("class_id", "vector").mapInArrow(best, "number long, class_id long, score double")
    top = _first(rows, "number", [F.desc("score"), F.col("class_id")], keep, "place").select("number", "class_id").collect()
    wanted = sorted({r["class_id"] for r in top})
    vectors = {r["class_id"]: r["vector"] for r in classes.where(F.col("class_id").isin(wanted)).select("class_id", "vector").collect()} if wanted else {}
    near: list[list] = [[] for _ in ids]
    for r in top:
        near[r["number"]].append(vectors[r["class_id"]])
    return [np.array(found, np.float64).reshape(len(found), queries.shape[1]) for found in near]


def _best(keep: int):
    """Exact inner products of each query with the members of the buckets it probes; the best `keep` per query."""

    def search(key, members: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_class": pa.array([], pa.int64()), "class_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not members.num_rows or not queries.num_rows:
            return empty
        members = members.sort_by([("bucket", "ascending"), ("class_id", "ascending")])
        x, q = _matrix(members["vector"]), _matrix(queries["vector"])
        buckets, ids = members["bucket"].to_numpy(), members["class_id"].to_numpy()
        probes = queries["buckets"].combine_chunks()
        asked = probes.flatten().to_numpy()
        asker = np.repeat(np.arange(len(q)), np.array(probes.value_lengths()))
        names, starts = np.unique(buckets, return_index=True)
        ends = np.append(starts[1:], len(buckets))
        order = np.argsort(asked, kind="stable")
        asked, asker = asked[order], asker[order]
        rows, columns = [], []
        for name, start, end in zip(names, starts, ends):
            everyone = asker[np.searchsorted(asked, name, "left") : np.searchsorted(asked, name, "right")]
            for at in range(0, len(everyone), _CHUNK):
                who = everyone[at : at + _CHUNK]
                scores = q[who] @ x[start:end].T
                if end - start > keep:
                    least = np.partition(scores, -keep, axis=1)[:, -keep]
                    i, j = np.nonzero(scores >= (least - 1e-9 * np.abs(least))[:, None])
                else:
                    i, j = (part.ravel() for part in np.indices(scores.shape))
                rows.append(who[i])
                columns.append(start + j)
        if not rows:
            return empty
        i, j = np.concatenate(rows), np.concatenate(columns)
        scores = np.concatenate([(q[i[at : at + 65536]] * x[j[at : at + 65536]]).sum(axis=1) for at in range(0, len(i), 65536)])
        order = np.lexsort((ids[j], -scores, i))
        i, j, scores = i[order], j[order], scores[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, "left")
        top = place < keep
        return pa.table({"query_class": queries["query_class"].to_numpy()[i[top]], "class_id": ids[j[top]], "score": scores[top]})

    return search


def _searched(members: DataFrame, probes: DataFrame, vectors: DataFrame, keep: int) -> DataFrame:
    """Best classes per query: members (group, bucket, class_id, vector) against probes (group, query_class, bucket).

    Queries of a group are dealt into blocks too, and each block gets a copy of the group's members.
    """
    asked = written(probes.groupBy("group", "query_class").agg(F.collect_set("bucket").alias("buckets")), "probes")
    blocks = asked.groupBy("group").count().select("group", F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("blocks"))
    asked = asked.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("query_class"), F.col("blocks")).cast("int"))
    asked = asked.join(vectors, "query_class").select("group", "block", "query_class", "buckets", "vector")
    seated = members.join(blocks, "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    seated = seated.select("group", "block", "bucket", "class_id", "vector")
    pairs = seated.groupBy("group", "block").cogroup(asked.groupBy("group", "block"))
    return pairs.applyInArrow(_best(keep), "query_class long, class_id long, score double")


def _first(rows: DataFrame, by: str, order: list[Column], most: int, rank: str) -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= most)


def nearest(vectors: DataFrame, queries: Column, neighbours: int = NEIGHBOURS, block_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `neighbours` vectors of largest inner product found for each query.

    vectors: vec_id, embedding (array of numbers). queries: a condition on vec_id that picks the query rows. A query
    gets all other vectors, if there are fewer; ties go to the smaller vec_id. Vectors of another length than the query's
    are no candidates. Vectors that are null, zero or hold a component that is null or not finite take no part, nor do
    rows without vec_id; of rows that share a vec_id the least vector counts. An empty table gives no rows.

    Equal vectors are one class in the search, of which the `neighbours` + 1 smallest ids can matter. Each class lies in
    one bucket of each table; queries visit buckets in estimated order of success. Small buckets share tasks, a bucket
    of more than block_rows (by default, as many vectors as take BLOCK_BYTES) is dealt over several, and each task reranks
    exactly and hands on the best of each query.
    Functions, width and probes are fitted together (`fitted`): the first SAMPLE_QUERIES of the SAMPLE_ROWS
    vectors of smallest hash are searched exactly in the whole table, and the cheapest choice that finds RECALL of their
    neighbours is taken. If none does, all vectors of that length are searched, block by block, as they are for queries
    whose visited buckets hold too few candidates.
    """
    ready(vectors.sparkSession)
    keep = neighbours + 1
    valid = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("vector"))
    valid = valid.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    valid = written(valid.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    classes = written(valid.groupBy("vector").agg(F.min("vec_id").alias("class_id")), "vector-classes")
    classes = classes.select("class_id", "vector", F.size("vector").alias("dimension"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = classes.groupBy("dimension").agg(F.count("*").alias("n"), F.max(square).alias("square"))
    plan, total = {}, 0
    for dimension, n, most in sizes.collect():  # one row per vector length
        order = [F.xxhash64(F.lit(SEED), F.col("class_id")), F.col("class_id")]
        sample = classes.where(F.col("dimension") == dimension).orderBy(*order).limit(SAMPLE_ROWS).select("class_id", "vector").collect()
        points = np.array([row["vector"] for row in sample], np.float64)
        asked = points[:SAMPLE_QUERIES]
        same = classes.where(F.col("dimension") == dimension)
        near = _exact_neighbours(same, [row["class_id"] for row in sample[:SAMPLE_QUERIES]], asked, neighbours)
        plan[dimension] = fitted(asked, near, points, float(np.sqrt(most)), n)
        total = max(total, n)
    block_rows = block_rows or max(256, BLOCK_BYTES // (4 * max([1, *plan])))
    groups = max(1, -(-total // block_rows))

    def hashed(batches):
        for batch in batches:
            for size, part in _by_dimension(batch):
                hashing = plan[size]
                if hashing is None:
                    continue
                keys = hashing.keys(np.floor(hashing.places(_matrix(part["vector"]), query=False)))
                rows = pa.array(np.repeat(np.arange(len(keys)), hashing.tables))
                tables = pa.array(np.tile(np.arange(hashing.tables, dtype=np.int32), len(keys)))
                yield pa.RecordBatch.from_arrays(
                    [part["dimension"].take(rows), tables, pa.array(keys.ravel()), part["class_id"].take(rows), part["vector"].take(rows)],
                    ["dimension", "table", "bucket", "class_id", "vector"],
                )

    def probing(batches):
        for batch in batches:
            for size, part in _by_dimension(batch):
                hashing = plan[size]
                if hashing is None:
                    continue
                cells = hashing.probed(_matrix(part["vector"]))
                counts = [[len(cell) for cell in tables] for tables in cells]
                keys = hashing.keys(np.concatenate([cell for tables in cells for cell in tables]))
                rows = pa.array(np.repeat(np.arange(len(cells)), [sum(c) for c in counts]))
                tables = np.concatenate([np.repeat(np.arange(len(c), dtype=np.int32), c) for c in counts])
                yield pa.RecordBatch.from_arrays(
                    [part["dimension"].take(rows), pa.array(tables), pa.array(keys), part["query_class"].take(rows)],
                    ["dimension", "table", "bucket", "query_class"],
                )

    kind = vectors.schema["embedding"].dataType.simpleString()
    if not plan:
        return _ranked(vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double"), neighbours)
    index = classes.mapInArrow(hashed, f"dimension int, table int, bucket long, class_id long, vector {kind}")
    index = written(index, "index")
    asking = valid.where(queries).select(F.col("vec_id").alias("query_id"), "vector")
    asking = written(asking.join(classes, "vector").select("query_id", F.col("class_id").alias("query_class"), "dimension"), "queries")
    query_vectors = classes.join(asking.select(F.col("query_class").alias("class_id")).distinct(), "class_id")
    query_vectors = written(query_vectors.select(F.col("class_id").alias("query_class"), "vector", "dimension"), "query-vectors")
    probes = query_vectors.mapInArrow(probing, "dimension int, table int, bucket long, query_class long")

    bucket = ["dimension", "table", "bucket"]
    parts = index.groupBy(*bucket).count().withColumn("parts", F.ceil(F.col("count") / block_rows).cast("int"))
    slot = F.when(F.col("parts") > 1, F.col("bucket")).otherwise(F.pmod("bucket", F.lit(groups)))
    parts = written(parts.select(*bucket, "parts", slot.alias("slot"), (F.col("parts") > 1).alias("large")), "buckets")
    group = F.struct("dimension", "table", "large", "slot", "part").alias("group")
    seated = index.join(parts, bucket).withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
    reached = probes.join(parts, bucket).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = _searched(
        seated.select(group, "bucket", "class_id", "vector"), reached.select(group, "bucket", "query_class"),
        query_vectors.select("query_class", "vector"), keep,
    )
    best = [F.desc("score"), F.col("class_id")]
    found = written(_first(found.distinct(), "query_class", best, keep, "place").drop("place"), "found")

    members = valid.join(classes, "vector").select("class_id", "vec_id")
    members = written(_first(members, "class_id", [F.col("vec_id")], keep, "nth").select("class_id", "vec_id"), "members")
    counts = members.groupBy("class_id").count()
    candidates = valid.groupBy(F.size("vector").alias("dimension")).agg(F.least(F.lit(keep), F.count("*")).alias("enough"))
    have = found.join(counts, "class_id").groupBy("query_class").agg(F.sum("count").alias("have"))
    short = query_vectors.join(candidates, "dimension").join(have, "query_class", "left").where("coalesce(have, 0) < enough")
    short = written(short.select("query_class", "dimension"), "short")
    if short.limit(1).count():
        block = F.pmod(F.xxhash64("class_id"), F.lit(groups)).alias("bucket")
        plain = classes.select("dimension", block, "class_id", "vector")
        every = short.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        place = F.struct("dimension", "bucket").alias("group")
        exact = _searched(
            plain.select(place, "bucket", "class_id", "vector"), every.select(place, "bucket", "query_class"),
            query_vectors.select("query_class", "vector"), keep,
        )
        found = _first(found.union(exact).distinct(), "query_class", best, keep, "place").drop("place")
    expanded = found.join(members, "class_id").select("query_class", "vec_id", "score")
    expanded = _first(expanded, "query_class", [F.desc("score"), F.col("vec_id")], keep, "place").drop("place")
    rows = asking.select("query_id", "query_class").join(expanded, "query_class").where("query_id <> vec_id")
    return _ranked(rows.select("query_id", "vec_id", "score"), neighbours)


def _ranked(rows: DataFrame, neighbours: int) -> DataFrame:
    ranked = _first(rows, "query_id", [F.desc("score"), F.col("vec_id")], neighbours, "rank")
    return ranked.select("query_id", "rank", "vec_id", "score")
