"""Document fingerprints by min-wise hashing, and near-duplicate documents by their bands."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.common import WORD_HASHES, Rolling, mixed, ready
from cinderlog.llm.components import components
from cinderlog.sources.workspace import written

SHINGLE, PERMUTATIONS, BANDS, LIKENESS, SEED = 5, 64, 16, 0.8, 4
#: Rows and shingles of a block, and how many representatives of a large group are tried before its rest meets all of it.
BLOCK_ROWS, BLOCK_SHINGLES, ROUNDS = 512, 1 << 20, 3
_CHUNK = 4096


class Signer:
    """Signatures of texts: the least value of each of a family of universal hashes over the text's word shingles.

    A shingle is `shingle` words in a row (all words, if there are fewer; none for a text without words). A hash is
    (a * x + b) modulo 2^64, its upper half, with a odd: one multiplication for a whole column of shingles.
    """

    def __init__(self, permutations: int = PERMUTATIONS, shingle: int = SHINGLE, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 1 << 63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, permutations, np.uint64) * np.uint64(2)
        self.shingle = shingle

    def shingles(self, text: str) -> np.ndarray:
        """Hashes of the shingles of a text, repeats included; letters A-Z count as a-z."""
        hashes = WORD_HASHES.of(text.encode().lower().split())
        n = min(self.shingle, len(hashes))
        if not n:
            return hashes
        base, total = np.uint64(1), np.zeros(len(hashes) - n + 1, np.uint64)
        for i in range(n):
            total += hashes[i : len(hashes) - n + 1 + i] * base
            base = np.uint64((int(base) * int(Rolling.BASE)) & (1 << 64) - 1)
        return mixed(total)

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for start in range(0, len(shingles), _CHUNK):
            values = shingles[start : start + _CHUNK]
            rows = values[None, :] * self.a[:, None]
            rows += self.b[:, None]
            rows >>= np.uint64(32)
            np.minimum(least, rows.min(axis=1).astype(np.uint32), out=least)
        return least

    def __call__(self, text: str) -> np.ndarray:
        return self.sign(self.shingles(text))


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal places of two signatures, which estimates the Jaccard similarity of the shingles."""
    return float(np.mean(a == b))


def printed(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def signatures(docs: DataFrame, permutations: int = PERMUTATIONS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and signature (array of 32-bit numbers as longs) of each whole text; null is signed as the empty text."""
    ready(docs.sparkSession)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(permutations, shingle)
        for batch in batches:
            rows = np.array([sign(text) for text in batch["text"].to_pylist()], np.int64).reshape(-1)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * permutations)
            lists = pa.ListArray.from_arrays(offsets, pa.array(rows))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], ["doc_id", "signature"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return rows.mapInArrow(signed, "doc_id long, signature array<long>")


# --- neighbours in the order of ids ---------------------------------------------------------------------------------

def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows dealt by ranges of doc_id, each range with one row more: the first of the range that comes after it.

    Order is doc_id descending (null last), then text; after the last row comes the first. Gives doc_id, text, range_no and
    guest; inside a range, own rows in order and then the guest (if there are several, the first counts), sorted within
    partitions. Range bounds are quantiles of doc_id, one number per range; whole rows move once.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"))
    bounds = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else None
    bounds = sorted(set(bounds or []))

    @F.pandas_udf("long")
    def range_of(column: pd.Series) -> pd.Series:
        number = np.searchsorted(np.array(bounds, np.int64), column.fillna(0).to_numpy(np.int64), side="right") + 1
        return pd.Series(np.where(column.notna(), number, 0))

    number = range_of("doc_id") if bounds else F.when(F.col("doc_id").isNull(), 0).otherwise(1).cast("long")
    numbered = ids.withColumn("range_no", number)
    heads = numbered.groupBy("range_no").agg(F.max("doc_id").alias("head"))
    # One row per range: the head of each is the guest of the next higher range, the highest head that of the lowest.
    heads = sorted(heads.collect(), key=lambda row: row[0])
    guests = [(low[1], heads[(i + 1) % len(heads)][0]) for i, low in enumerate(heads)]
    table = spark.createDataFrame(guests, "head long, host long")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.withColumn("range_no", range_of("doc_id") if bounds else F.when(F.col("doc_id").isNull(), 0).otherwise(1).cast("long"))
    rows = rows.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("head")), "left").drop("head")
    own = F.struct(F.col("range_no"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("host").alias("range_no"), F.lit(True).alias("guest"))
    seats = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))
    seated = rows.select("doc_id", "text", F.explode(seats).alias("seat")).select("doc_id", "text", "seat.*")
    return seated.repartition("range_no").sortWithinPartitions("range_no", "guest", F.desc_nulls_last("doc_id"), "text")


def half_replaced(text: str, other: str) -> str:
    """The text with its last half of code points replaced by the first as many (or all) of another."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def edit_likeness(docs: DataFrame, permutations: int = PERMUTATIONS, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and how alike they are.

    docs: doc_id, text (null: empty). The edited text has its last half replaced by the beginning of the next document
    in descending order of doc_id (after the last: the first). Gives doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (8 hex digits per hash), near_edited and near_next. Rows that share a doc_id follow one another
    in order of text, a null doc_id comes last; a lone document is its own next; an empty table gives no rows. Texts
    without words have the fingerprint of all ones and are alike to each other only.
    """
    ready(docs.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(permutations, shingle)
        held = None  # the last own row: its next is not seen yet
        for batch in batches:
            out = []
            columns = (batch[name].to_pylist() for name in ("doc_id", "text", "range_no", "guest"))
            for doc_id, text, number, guest in zip(*columns):
                mark = sign(text)
                if held is not None and held[2] == number:
                    edited = half_replaced(held[1], text)
                    other = sign(edited)
                    out.append((
                        held[0], len(held[1]), hashlib.sha256(edited.encode()).hexdigest(), printed(held[3]), printed(other),
                        alike(held[3], other), alike(held[3], mark),
                    ))
                held = None if guest else (doc_id, text, number, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), kinds)], names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(compare, schema)


# --- near-duplicate documents ---------------------------------------------------------------------------------------

def near_duplicates(
    docs: DataFrame, likeness: float = LIKENESS, bands: int = BANDS, permutations: int = PERMUTATIONS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """doc_id and class_id, the smallest doc_id reachable over pairs of texts whose shingle sets are alike enough.

    docs: doc_id, text. Texts with the same shingles (letter case and spacing aside) are collapsed first. Signatures are
    cut into bands, texts that agree in a band are candidates, and the Jaccard similarity of their shingle sets is
    computed exactly; pairs at `likeness` or more link. Groups of a band are compared in tasks of bounded blocks, large
    ones with a few representatives first; what these do not bring together meets the whole group, so no candidate is
    left out. Texts without words form one class. A null doc_id takes no part in the smallest; repeated rows
    are kept each.
    """
    draw, width = Signer(permutations), permutations // bands

    def keys(shingles: np.ndarray) -> np.ndarray:
        return mixed(draw.sign(shingles).astype(np.uint64).reshape(bands, width) @ draw.a[:width] + draw.a[:bands]).view(np.int64)

    def banded(classes: DataFrame) -> DataFrame:
        return classes.select("content", "size", F.posexplode("marks").alias("band", "key"))

    signed, rooted = near_classes(docs, keys, bands, banded, likeness, block_rows)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least.doc_id").alias("class_id")), "root").select("content", "class_id")
    return signed.select("doc_id", "content").join(named, "content").select("doc_id", "class_id")


def one_of_each_class(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of each class that `near_classes` found, with the columns of docs: that of smallest doc_id, null last.

    Rows are told apart by doc_id and a hash of all their columns, so rows that share a doc_id, and those without one, are
    judged by their own texts. Of rows alike in every column one is kept.
    """
    least = rooted.groupBy("root").agg(F.min("least").alias("least")).select(*_named("least"))
    return _rows_of(docs, least).dropDuplicates(["_near_id", "_near_key"]).select(*docs.columns)


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64(*[part for name in docs.columns for part in (docs[name], docs[name].isNull())])


def _named(row: str) -> list[Column]:
    """The row's name in two columns that are never null (the key tells a null doc_id from zero)."""
    return [F.coalesce(F.col(row)["doc_id"], F.lit(0)).alias("_near_id"), F.col(row)["row_key"].alias("_near_key")]


def _rows_of(docs: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of docs that are named, with their names; repeated rows are there each."""
    keyed = docs.withColumns({"_near_id": F.coalesce(docs["doc_id"].cast("long"), F.lit(0)), "_near_key": _row_key(docs)})
    return keyed.join(names, ["_near_id", "_near_key"])


def near_classes(
    docs: DataFrame, marks: Callable[[np.ndarray], np.ndarray], width: int, groups: Callable[[DataFrame], DataFrame], likeness: float, block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Rows with the content (a hash of the shingle set) of their texts, and per content its least row and its class' root.

    `marks` gives `width` signed numbers for the distinct shingles of a text, `groups` the candidates from them: of
    (content, size, marks) groups (content, size, band, key) in which contents that are alike enough come together.
    """
    spark = ready(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer()
        for batch in batches:
            sets = [np.unique(sign.shingles(text)) for text in batch["text"].to_pylist()]
            flat = pa.array(np.concatenate([*map(marks, sets), np.zeros(0, np.int64)]))
            content, size = pa.array([_content(one) for one in sets], pa.int64()), pa.array([len(one) for one in sets], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width), flat)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["row_key"], content, size, lists], ["doc_id", "row_key", "content", "size", "marks"],
            )

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer()
        for batch in batches:
            sets = [np.unique(sign.shingles(text)) for text in batch["text"].to_pylist()]
            content = pa.array([_content(one) for one in sets], pa.int64())
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([content, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["content", "shingles"])

    text = F.coalesce(docs["text"], F.lit("")).alias("text")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _row_key(docs).alias("row_key"), text)
    signed = written(rows.mapInArrow(read, "doc_id long, row_key long, content long, size long, marks array<long>"), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")
    classes = written(signed.groupBy("content").agg(F.min(row).alias("least"), F.min("size").alias("size"), F.first("marks").alias("marks")), "contents")
    banded = groups(classes)
    # Of groups with the same members (as those of near copies mostly have) one is looked at.
    alike = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("content")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "content")).alias("two")]
    shared = banded.groupBy("band", "key").agg(*alike).where("n > 1")
    shared = shared.groupBy("n", "one", "two").agg(F.min(F.struct("band", "key")).alias("group")).select("group.*")
    members = written(banded.join(shared, ["band", "key"]), "band-members")
    asked = classes.join(members.select("content").distinct(), "content", "left_semi").select(*_named("least"))
    found = _rows_of(docs, asked).select("_near_id", "_near_key", F.coalesce("text", F.lit("")).alias("text"))
    found = found.dropDuplicates(["_near_id", "_near_key"]).select("text")
    sets = written(found.mapInArrow(shingled, "content long, shingles array<long>"), "shingle-sets")
    links = _links(spark, members, sets, likeness, block_rows)
    roots = components(links)
    rooted = classes.join(roots, F.col("content") == F.col("node"), "left").select("content", "least", F.coalesce("root", "content").alias("root"))
    return signed, written(rooted, "text-roots")


def _content(shingles: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mixed(shingles + np.uint64(1)), initial=np.uint64(len(shingles))).view(np.int64))


def _links(spark, members: DataFrame, sets: DataFrame, likeness: float, block_rows: int) -> DataFrame:
    """Verified links (a, b) that give the components of all alike pairs in the groups of `members`.

    A group's members in its largest component so far need no comparison with each other: the others (the rest) are
    compared with all. While the rest of a group is larger than a block, one of the rest is first compared with all
    the others, up to ROUNDS times and as long as that halves the rest; after that the rest is compared with the whole
    group, however large it is. Only groups that are in a round are looked at anew after it; the others meet the
    components found once, at the end.
    """
    links = spark.createDataFrame([], "a long, b long")
    state, rested = members.withColumn("root", F.col("content")), []
    group = ["band", "key"]
    for turn in range(ROUNDS):
        tops = _open_groups(state)
        large = tops.where((F.col("rest") > block_rows) & (F.col("rest") * (1 << turn) <= F.col("n")))
        if not large.limit(1).count():
            break
        rested.append(state.join(large.select(*group), group, "left_anti"))
        placed = state.join(large, group).withColumn("block", _block(block_rows))
        draw = F.struct(F.xxhash64(F.lit(turn), "content").alias("draw"), "content", "size", "root")
        chosen = placed.where("root <> main").groupBy(*group).agg(F.min(draw).alias("one"))
        rights = placed.withColumn("i", F.lit(0)).withColumn("j", F.col("block"))
        lefts = chosen.select(*group, "one.content", "one.size", "one.root")
        lefts = lefts.join(rights.select(*group, "i", "j").distinct(), group)
        links = written(links.union(_compared(lefts, rights, sets, likeness, block_rows)).distinct(), "alike-links")
        roots = written(components(links), "alike-roots")
        state = written(_rooted(placed.select(*members.columns), roots), "group-states")
    if rested:
        for part in [_rooted(rested[0].select(*members.columns), roots), *rested[1:]]:
            state = state.unionByName(part)
        state = written(state, "group-states")
        tops = _open_groups(state)
    # The rest of a block meets its own block, all later ones, and what is not of the rest in earlier ones.
    placed = state.join(tops, group).withColumn("block", _block(block_rows))
    blocks = placed.groupBy(*group, "block").agg(F.max(F.col("root") != F.col("main")).alias("rests"), F.max(F.col("root") == F.col("main")).alias("mains"))
    blocks = written(blocks, "group-blocks")
    pairs = blocks.where("rests").select(*group, F.col("block").alias("i")).join(blocks.select(*group, F.col("block").alias("j"), "mains"), group)
    pairs = written(pairs.where("i <= j or mains").select(*group, "i", "j"), "block-pairs")
    lefts = placed.where("root <> main").join(pairs.withColumn("block", F.col("i")), [*group, "block"])
    rights = placed.join(pairs.withColumn("block", F.col("j")), [*group, "block"]).where("i <= j or root = main")
    return written(links.union(_compared(lefts, rights, sets, likeness, block_rows)).distinct(), "alike-links")


def _open_groups(state: DataFrame) -> DataFrame:
    """Groups (band, key) of more than one component, with the largest one (main) and how many members are outside (rest)."""
    parts = state.groupBy("band", "key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("amount"))
    tops = parts.groupBy("band", "key").agg(
        F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("n"), F.sum("amount").alias("amount"),
        F.count("*").alias("parts"), (F.sum("n") - F.max("n")).alias("rest"),
    )
    return written(tops.where("parts > 1"), "open-groups")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with the roots of their components so far."""
    joined = members.join(roots, F.col("content") == F.col("node"), "left")
    return joined.withColumn("root", F.coalesce("root", "content")).drop("node")


def _compared(lefts: DataFrame, rights: DataFrame, sets: DataFrame, likeness: float, block_rows: int) -> DataFrame:
    """Links of the left members to the right ones of the same task (band, key, i, j)."""
    task = F.struct("band", "key", "i", "j")
    sides = [side.select("content", "size", "root", task.alias("pair"), F.lit(no).alias("side")) for no, side in enumerate((lefts, rights))]
    tasks = written(sides[0].union(sides[1]), "compared")
    rows, amount = tasks.agg(F.count("*"), F.sum("size")).first()
    bundles = max(1, -(-rows // block_rows), -(-(amount or 0) // BLOCK_SHINGLES))
    tasks = tasks.withColumn("bundle", F.pmod(F.xxhash64("pair"), F.lit(bundles))).withColumn("pair", F.xxhash64("pair")).join(sets, "content")
    return tasks.groupBy("bundle").applyInPandas(lambda frame: _bundled(frame, likeness), "a long, b long")


def _bundled(frame: pd.DataFrame, likeness: float) -> pd.DataFrame:
    """The links of all tasks of a bundle."""
    found = [_alike_links(task, likeness) for _, task in frame.groupby("pair", sort=False)]
    return pd.concat(found) if found else pd.DataFrame({"a": [], "b": []}, dtype=np.int64)


def _block(block_rows: int) -> Column:
    """The block of its group that a member is dealt to."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows), F.ceil(F.col("amount") / BLOCK_SHINGLES))
    return F.pmod(F.xxhash64("content"), blocks).cast("int")


def _alike_links(frame: pd.DataFrame, likeness: float) -> pd.DataFrame:
    """Links from the left rows of a task to its right ones, as far as they join what was not joined before."""
    right = frame["side"].to_numpy() == 1
    ids = frame["content"].to_numpy(np.int64)
    names, root = np.unique(frame["root"].to_numpy(np.int64), return_inverse=True)
    root = root.reshape(-1).copy()
    known = np.arange(len(names))
    sizes = np.array([len(one) for one in frame["shingles"]], np.int64)
    flat = np.concatenate([np.asarray(one, np.int64) for one in frame["shingles"]]) if len(frame) else np.zeros(0, np.int64)
    codes = np.unique(flat, return_inverse=True)[1].reshape(-1)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    marked = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
    lefts, rights = np.flatnonzero(~right), np.flatnonzero(right & (sizes > 0))
    out = []
    for i in lefts:
        n = sizes[i]
        fits = np.minimum(sizes[rights], n) >= likeness * np.maximum(sizes[rights], n)
        open_ = rights[fits & (known[root[rights]] != known[root[i]])]
        if not n or not len(open_):
            continue
        marked[codes[starts[i] : ends[i]]] = True
        owner = np.repeat(np.arange(len(open_)), sizes[open_])
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[open_]) - sizes[open_], sizes[open_]) + starts[open_][owner]
        common = np.bincount(owner, marked[codes[at]], len(open_))
        marked[codes[starts[i] : ends[i]]] = False
        for j in open_[common >= likeness * (n + sizes[open_] - common)]:
            a, b = known[root[i]], known[root[j]]
            if a != b:
                known[known == max(a, b)] = min(a, b)
                out.append((ids[i], ids[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
