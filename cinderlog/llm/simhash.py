"""Near-duplicate groups by similarity fingerprints joined over binary tries: at a budget of bits, or verified on shingles."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm import minhash
from cinderlog.llm.common import group_roots, mixed, ready
from cinderlog.llm.components import components
from cinderlog.sources.workspace import written

SHINGLE, MAX_BITS, LEAF_ROWS, STEP = 3, 2, 1 << 14, 4
#: Words of 64 bits of a wide fingerprint, its seed, and the chance to miss a pair that is just alike enough.
WORDS, SEED, MISSED = 3, 11, 1e-4
_TILE, _WIDE = 256, 2048
#: Node pairs looked at together, and the size of node pairs that are compared outright.
_FRONT, _SMALL = 1 << 17, 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit by bit the majority of the shingles' hashes, as a signed 64-bit number."""
    words = text.encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: max(1, len(words) - shingle + 1)].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, stops)], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint (a signed long); a text that is null or has no word gets 0."""
    ready(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprinted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([fingerprint(text) for text in series], dtype="int64")

    return docs.select(docs["doc_id"], fingerprinted(F.coalesce(docs["text"], F.lit(""))).alias("fp"))


def _prefix(fp: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", fp, (64 - depth).cast("int")))


def leaves(prints: DataFrame, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, DataFrame]:
    """Cut the trie of the distinct fingerprints into leaves of at most leaf_rows, and pair the leaves that can be near.

    prints: fp. Gives (fp, depth, prefix) and the pairs (a_depth, a_prefix, b_depth, b_prefix) whose prefixes differ in
    at most MAX_BITS bits. Traversal begins at the depth where even fingerprints would fill leaves: there the partners of
    a node are found by flipping up to MAX_BITS bits. While nodes are too large, they and the pairs they are in are
    replaced by their children STEP bits deeper, and pairs whose differing bits exceed the budget are dropped.
    """
    total = prints.count()
    depth = 0
    while (total >> depth) > leaf_rows:
        depth += 1
    depth = max(0, depth // STEP * STEP)
    placed = prints.select("fp", F.lit(depth).alias("depth"), _prefix(F.col("fp"), depth).alias("prefix"))
    nodes = placed.groupBy("depth", "prefix").count().withColumn("open", F.col("count") > leaf_rows).drop("count")
    nodes = written(nodes, "trie-nodes")
    masks = [0, *[1 << i for i in range(depth)], *[1 << i | 1 << j for i in range(depth) for j in range(i)]]
    flips = F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
    reach = nodes.withColumn("flip", flips).select(
        F.col("depth").alias("a_depth"), F.col("prefix").alias("a_prefix"), F.col("open").alias("a_open"),
        F.col("prefix").bitwiseXOR(F.col("flip")).alias("b_prefix"),
    )
    other = nodes.select(F.col("depth").alias("b_depth"), F.col("prefix").alias("b_prefix"), F.col("open").alias("b_open"))
    pairs = reach.join(other, "b_prefix").where("a_prefix <= b_prefix")
    while nodes.where("open").limit(1).count():
        pairs = written(pairs, "trie-pairs")
        wide = nodes.where("open").select(F.col("depth").alias("o_depth"), F.col("prefix").alias("o_prefix"))
        inner = placed.join(wide, (F.col("depth") == F.col("o_depth")) & (F.col("prefix") == F.col("o_prefix")), "left")
        deeper = F.when(F.col("o_depth").isNotNull(), F.col("depth") + STEP).otherwise(F.col("depth"))
        placed = written(inner.select("fp", deeper.alias("depth")).withColumn("prefix", _prefix(F.col("fp"), F.col("depth"))), "trie-rows")
        depth += STEP
        nodes = placed.where(F.col("depth") == depth).groupBy("depth", "prefix").count()
        nodes = written(nodes.withColumn("open", (F.col("count") > leaf_rows) & F.lit(depth < 64)).drop("count"), "trie-nodes")
        for side in "ab":
            children = nodes.select(
                F.col("depth").alias("c_depth"), F.col("prefix").alias("c_prefix"), F.col("open").alias("c_open"),
                _parent(F.col("prefix"), depth).alias("p_prefix"),
            )
            there = F.col(f"{side}_open") & (F.col(f"{side}_prefix") == F.col("p_prefix")) & (F.col(f"{side}_depth") == depth - STEP)
            joined = pairs.withColumn("same", (F.col("a_depth") == F.col("b_depth")) & (F.col("a_prefix") == F.col("b_prefix"))) if side == "a" else pairs
            joined = joined.join(children, there, "left")
            for name in ("depth", "prefix", "open"):
                joined = joined.withColumn(f"{side}_{name}", F.coalesce(f"c_{name}", f"{side}_{name}"))
            pairs = joined.drop("c_depth", "c_prefix", "c_open", "p_prefix")
        pairs = pairs.where("not same or a_prefix <= b_prefix").drop("same").where(_differing() <= MAX_BITS)
    pairs = pairs.select("a_depth", "a_prefix", "b_depth", "b_prefix")
    return placed, written(pairs, "trie-pairs")


def _parent(prefix: Column, depth: int) -> Column:
    return F.lit(0).cast("long") if depth == STEP else F.call_function("shiftrightunsigned", prefix, F.lit(STEP))


def _differing() -> Column:
    """Bits in which the prefixes of a pair differ, as far as both go."""
    shared = F.least("a_depth", "b_depth")
    cut = [F.call_function("shiftrightunsigned", F.col(f"{s}_prefix"), (F.col(f"{s}_depth") - shared).cast("int")) for s in "ab"]
    return F.when(shared == 0, F.lit(0)).otherwise(F.bit_count(cut[0].bitwiseXOR(cut[1])))


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool, max_bits: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted arrays of distinct fingerprints that differ in at most max_bits bits.

    A node of a trie is a run of its sorted array. Pairs of nodes go down together, bit by bit; what they differ in
    adds up, and a pair is pruned beyond the budget. Fronts are taken from a stack in bounded chunks.
    """
    zero = np.zeros(1, np.int64)
    stack = [(63, zero, zero + len(a), zero, zero + len(b), zero)]
    while stack:
        bit, a0, a1, b0, b1, spent = stack.pop()
        if len(a0) > _FRONT:
            half = len(a0) // 2
            stack.append((bit, *(x[half:] for x in (a0, a1, b0, b1, spent))))
            stack.append((bit, *(x[:half] for x in (a0, a1, b0, b1, spent))))
            continue
        area = (a1 - a0) * (b1 - b0)
        small = (area <= _SMALL) | (bit < 0)
        if small.any():
            yield from _compared(a, b, a0[small], a1[small], b0[small], b1[small], same, max_bits)
            a0, a1, b0, b1, spent = (x[~small] for x in (a0, a1, b0, b1, spent))
        if not len(a0):
            continue
        low = np.uint64((1 << bit) - 1)
        above = ~((low << np.uint64(1)) | np.uint64(1))
        one = np.uint64(1 << bit)
        am = np.searchsorted(a, (a[a0] & above) | one).clip(a0, a1)
        bm = np.searchsorted(b, (b[b0] & above) | one).clip(b0, b1)
        twin = same & (a0 == b0) & (a1 == b1)
        sides = [(a0, am, b0, bm, spent), (am, a1, bm, b1, spent), (a0, am, bm, b1, spent + 1), (am, a1, b0, bm, spent + 1)]
        kept = []
        for number, (x0, x1, y0, y1, cost) in enumerate(sides):
            keep = (x0 < x1) & (y0 < y1) & (cost <= max_bits)
            if number == 3:
                keep &= ~twin
            kept.append([x[keep] for x in (x0, x1, y0, y1, cost)])
        stack.append((bit - 1, *(np.concatenate(part) for part in zip(*kept))))


def _compared(a, b, a0, a1, b0, b1, same, max_bits):
    """Compare all members of the given (few or small) node pairs, in chunks."""
    area = (a1 - a0) * (b1 - b0)
    bounds = [0, *(np.flatnonzero(np.diff(np.cumsum(area) // (1 << 20))) + 1).tolist(), len(area)]
    for start, stop in zip(bounds, bounds[1:]):
        if start == stop:
            continue
        sizes = area[start:stop]
        owner = np.repeat(np.arange(start, stop), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        width = (b1 - b0)[owner]
        i, j = a0[owner] + place // width, b0[owner] + place % width
        near = np.bitwise_count(a[i] ^ b[j]) <= max_bits
        if same:
            near &= i < j
        yield i[near], j[near]


def _linked(frame: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """A spanning forest of the links between two leaves (or inside one): no link is lost to the components."""
    values = frame["fp"].to_numpy(np.int64)
    left, right = (np.sort(values[(frame["side"] == side).to_numpy()].view(np.uint64)) for side in (0, 1))
    same = not len(right)
    both = left if same else np.concatenate([left, right])
    root = np.arange(len(both))
    for i, j in near_pairs(left, left if same else right, same, max_bits):
        i, j = root[i], root[j if same else j + len(left)]
        root = group_roots(len(both), i, j)[root]
    child = np.flatnonzero(root != np.arange(len(both)))
    return pd.DataFrame({"a": both[child].view(np.int64), "b": both[root[child]].view(np.int64)})


def fingerprint_components(prints: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(node, root) for the distinct fingerprints in `prints` (fp) that link to others at MAX_BITS bits or fewer."""
    placed, pairs = leaves(prints, leaf_rows)
    pairs = pairs.withColumn("pair", F.struct("a_depth", "a_prefix", "b_depth", "b_prefix"))
    first = pairs.selectExpr("pair", "a_depth depth", "a_prefix prefix", "0 side")
    second = pairs.where("a_depth <> b_depth or a_prefix <> b_prefix").selectExpr("pair", "b_depth depth", "b_prefix prefix", "1 side")
    members = placed.join(first.union(second), ["depth", "prefix"]).select("pair", "side", "fp")
    links = members.groupBy("pair").applyInPandas(lambda frame: _linked(frame, MAX_BITS), "a long, b long")
    return components(links)


def simhash_groups(docs: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document: the smallest doc_id it reaches over links.

    docs: doc_id, text. Fingerprints link at MAX_BITS differing bits or fewer; documents of equal fingerprints are
    collapsed before the join, so groups of copies of any size cost one row. Texts that are null or without words have
    fingerprint zero, linked like any other. Rows that share a doc_id are kept each; a null doc_id takes no part in the
    smallest, and where a group has no other the component is null. An empty table gives no rows.
    """
    prints = written(fingerprints(docs), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = fingerprint_components(classes.select("fp"), leaf_rows)
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "fingerprint-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents whose doc_id is their group's component_id, once each. Those without an id cannot be named and stay."""
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    rows = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("_kept_id"), "left_semi")
    return rows.dropDuplicates(["doc_id"]).union(docs.where("doc_id is null"))


# --- near copies by the likeness of their shingle sets ---------------------------------------------------------------

def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """WORDS fingerprints of a set of shingle hashes, each under a seed of its own: the bits set in over half the hashes.

    Eight bits of a hash at a time add up in the bytes of a sum, 255 hashes before they are taken out.
    """
    if not len(shingles):
        return np.zeros(WORDS, np.int64)
    hashes = mixed(shingles ^ mixed(np.arange(SEED, SEED + WORDS, dtype=np.uint64))[:, None])
    lanes = (hashes[:, None, :] >> np.arange(8, dtype=np.uint64)[:, None]) & np.uint64(0x0101010101010101)
    sums = np.add.reduceat(lanes, np.arange(0, len(shingles), 255), axis=2)
    ones = sums.view(np.uint8).reshape(WORDS, 8, -1, 8).sum(axis=2, dtype=np.int64).transpose(0, 2, 1).reshape(WORDS, 64)
    return np.packbits(2 * ones > len(shingles), axis=1, bitorder="little").view("<i8").reshape(WORDS)


def _share_of_bits(likeness: float) -> float:
    """The share of bits in which two sets of this Jaccard similarity differ at most, on average.

    The angle between sets of equal size; other sizes are nearer. Sets of a few shingles, whose ties all give zero, differ
    up to a quarter more often: four shingles of five in 3 bits of 16.
    """
    return 1.25 * float(np.arccos(2 * likeness / (1 + likeness)) / np.pi)


def _chances(bits: int, share: float) -> np.ndarray:
    """Chances that 0, 1, ... of so many bits differ."""
    return np.array([comb(bits, d) * share**d * (1 - share) ** (bits - d) for d in range(bits + 1)])


def _budget(bits: int, likeness: float) -> int:
    """How many of so many bits may differ, so that pairs of this likeness stay but for MISSED."""
    return int(np.searchsorted(np.cumsum(_chances(bits, _share_of_bits(likeness))), 1 - MISSED))


def tries_for(depth: int, likeness: float) -> int:
    """How many tries are cut at this depth: a pair of this likeness shares a node of one of them but for MISSED."""
    bits = 64 * WORDS
    apart = 1 - np.array([comb(bits - d, depth) / comb(bits, depth) for d in range(bits + 1)])
    chances, tries = _chances(bits, _share_of_bits(likeness)), 1
    while chances @ apart**tries > MISSED:
        tries += 1
    return tries


def near_groups(prints: DataFrame, likeness: float, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Candidates for this likeness among (content, marks: a wide fingerprint): groups (content, band, key), two rows or more each.

    The bits are put in several orders, each of which makes a trie that is cut where even fingerprints fill leaf_rows; the
    more there are, the deeper, and the more tries. In a node, fingerprints within the budget of bits are linked, and what
    is linked is a group. A node that is much larger is dealt over blocks, every two of which meet in a task. Where prints
    have the size of the sets, sets too unlike in size to be alike are not linked, and the groups have it too.
    """
    sized = ["size"] if "size" in prints.columns else []
    spark = ready(prints.sparkSession)
    total, depth = prints.count(), 0
    while (total >> depth) > leaf_rows:
        depth += 1
    tries, draw = tries_for(depth, likeness), np.random.default_rng(SEED)
    per_order = 64 * WORDS // max(depth, 1)
    orders = np.concatenate([draw.permutation(64 * WORDS)[: per_order * depth].reshape(per_order, depth) for _ in range(-(-tries // per_order))])[:tries]
    limits = _budget(64, likeness), _budget(64 * WORDS, likeness)
    words = [f"word{i}" for i in range(WORDS)]

    def placed(with_words: bool) -> DataFrame:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch["marks"].flatten().to_numpy().reshape(-1, WORDS)
                bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
                band = np.repeat(np.arange(tries, dtype=np.int32), len(values))
                node = np.concatenate([bits[:, order] @ (1 << np.arange(depth)) for order in orders])
                named = [batch[name].to_numpy() for name in ("content", *sized)]
                columns = [band, node, *[np.tile(column, tries) for column in (*named, *values.T)]]
                columns = columns if with_words else columns[:2]
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], ["band", "node", "content", *sized, *words][: len(columns)])

        schema = "band int, node long"
        return prints.mapInArrow(place, schema + "".join(f", {name} long" for name in ("content", *sized, *words)) * with_words)

    wide = placed(False).groupBy("band", "node").count().where(F.col("count") > 2 * leaf_rows)
    wide = written(wide.select("band", "node", F.ceil(F.col("count") / leaf_rows).cast("int").alias("blocks")), "wide-nodes")
    rows = placed(True).withColumns({"i": F.lit(0), "j": F.lit(0)})
    if wide.limit(1).count():
        dealt = placed(True).join(wide, ["band", "node"], "left")
        block = F.coalesce(F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int"), F.lit(0))
        dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        rows = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("block", "other", "blocks")

    def grouped(frame: pd.DataFrame) -> pd.DataFrame:
        content = frame["content"].to_numpy(np.int64)
        sizes = frame["size"].to_numpy(np.int64) if sized else np.ones(len(frame), np.int64)
        root = _near_roots([frame[word].to_numpy(np.int64).view(np.uint64) for word in words], *limits, sizes, likeness)
        shared = np.bincount(root, minlength=len(root))[root] > 1
        task = np.uint64(hash(tuple(frame[name].iloc[0] for name in ("node", "i", "j"))) & (1 << 64) - 1)
        key = mixed(content[root[shared]].view(np.uint64) ^ mixed(np.array([task]))).view(np.int64)
        found = {"content": content[shared], "band": frame["band"].to_numpy(np.int32)[shared], "key": key}
        return pd.DataFrame(found | {name: sizes[shared] for name in sized})

    found = rows.groupBy("band", "node", "i", "j").applyInPandas(grouped, "content long, band int, key long" + "".join(f", {name} long" for name in sized))
    return written(found, "near-groups")


def _near_roots(words: list[np.ndarray], first: int, whole: int, sizes: np.ndarray, likeness: float) -> np.ndarray:
    """Per row the smallest row it reaches over pairs that differ in at most `first` bits of the first word and `whole` of all.

    Sets are alike only if the smaller has at least this share of the larger one's size; other pairs are none.
    """
    n = len(words[0])
    root = np.arange(n)
    for top in range(0, n, _TILE):
        for left in range(top, n, _WIDE):
            i, j = np.nonzero(np.bitwise_count(words[0][top : top + _TILE, None] ^ words[0][None, left : left + _WIDE]) <= first)
            i, j = i + top, j + left
            open_ = (i < j) & (root[i] != root[j])
            open_ &= np.minimum(sizes[i], sizes[j]) >= likeness * np.maximum(sizes[i], sizes[j])
            i, j = i[open_], j[open_]
            near = sum(np.bitwise_count(word[i] ^ word[j]).astype(np.int64) for word in words) <= whole
            if near.any():
                root = group_roots(n, root[i[near]], root[j[near]])[root]
    return root


def one_of_near_copies(docs: DataFrame, likeness: float = minhash.LIKENESS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row of each class of texts linked at a Jaccard similarity of `likeness` or more of their five-word shingle sets.

    Candidates come from fingerprints of those sets (`near_groups`), and each is verified on the sets; see `near_classes`
    and `one_of_each_class`. Sets too small to be alike without being equal are left out of the candidates.
    """
    def groups(classes: DataFrame) -> DataFrame:
        able = classes.where(F.col("size") >= likeness * (F.col("size") + 1))
        return near_groups(able.select("content", "size", "marks"), likeness, leaf_rows)

    return minhash.one_of_each_class(docs, minhash.near_classes(docs, wide_fingerprint, WORDS, groups, likeness)[1])
