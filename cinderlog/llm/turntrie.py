"""The trie of conversations by their turns: what each shared beginning holds, from sorted matrices of turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.common import ready
from cinderlog.sources.workspace import written

#: Turns in a row of a matrix; longer conversations go on in further rows. Turns in a shard; blocks whose sums are one step.
BLOCK_TURNS, SHARD_TURNS, STEP_BLOCKS = 32, 1 << 17, 1 << 10
HEAD_TURNS, FAMILY = 6, 100
NOTHING = hashlib.sha256(b"").hexdigest()
PIECE = (
    "range_no int, node binary, split boolean, depth long, conv_id long, parent binary, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary"
)
_ORDER = ("block", "q1", "q2", "ids", "more", "conv_id")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id (16 bytes that stand for role and text), chars of the text; rows without a conv_id are left out."""
    role, text = (F.coalesce(conversations[name].cast("string"), F.lit("")) for name in ("role", "text"))
    said = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"),
        F.unhex(F.md5(said.cast("binary"))).alias("id"), F.char_length(text).alias("chars"),
    )
    return rows.where("conv_id is not null")


def rebuilt(turns: DataFrame, head_turns: int = HEAD_TURNS, family: int = FAMILY) -> DataFrame:
    """conv_id, depth (from 1), id, chars, length of the rebuilt conversations, and a row of depth 0 for each of them.

    Turns are dealt by ranges of (conv_id, turn, id), so that a conversation may lie in many ranges: a turn's place is
    its place in its range plus what earlier ranges hold of the conversation, a row per range and conversation.
    """
    order = [F.asc_nulls_first("turn"), F.col("id")]
    ranges = turns.repartitionByRange(F.col("conv_id"), *order, F.monotonically_increasing_id()).withColumn("range_no", F.spark_partition_id())
    ranges = written(ranges, "turn-ranges")
    before = Window.partitionBy("conv_id").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ranges.groupBy("conv_id", "range_no").count().select(
        "conv_id", "range_no", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"),
        F.sum("count").over(Window.partitionBy("conv_id")).alias("total"),
    )
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    first = ranges.where(F.col("conv_id") % family == 0).select("conv_id", nth.alias("nth"), "id", "chars").where(F.col("nth") < head_turns)
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("nth", "id", "chars"))).alias("head"))
    asked = F.crc32(F.col("conv_id").cast("string").cast("binary")) % head_turns
    pieces = pieces.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).withColumn("asked", asked.cast("int")).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("asked"))
    pieces = pieces.withColumn("head", head).withColumn("length", F.size("head") + F.greatest(F.col("total") - F.col("asked"), F.lit(0)))
    pieces = written(pieces.select("conv_id", "range_no", "shift", "asked", "head", "length"), "turn-pieces")
    inside = F.row_number().over(Window.partitionBy("range_no", "conv_id").orderBy(*order))
    placed = ranges.withColumn("place", inside).join(pieces.withColumn("inherited", F.size("head")).drop("head"), ["range_no", "conv_id"])
    place = F.col("place") + F.col("shift")
    own = placed.where(place > F.col("asked")).select("conv_id", (place - F.col("asked") + F.col("inherited")).alias("depth"), "id", "chars", "length")
    top = F.array(F.struct(F.lit(0).alias("nth"), F.lit(None).cast("binary").alias("id"), F.lit(0).alias("chars")))
    inherited = pieces.where("shift = 0").select("conv_id", F.explode(F.concat(top, "head")).alias("turn"), "length")
    return own.union(inherited.select("conv_id", F.col("turn.nth").cast("long").alias("depth"), "turn.id", "turn.chars", "length"))


def _over_blocks(rows: DataFrame, values: list[str], total, later: bool) -> DataFrame:
    """conv_id, block and `total` of the values over all earlier (or later) blocks of the conversation, in two steps."""
    step = F.floor(F.col("block") / STEP_BLOCKS)
    ends = (1, Window.unboundedFollowing) if later else (Window.unboundedPreceding, -1)
    rows = rows.withColumn("step", step)
    steps = rows.groupBy("conv_id", "step").agg(*[total(v).alias(v) for v in values])
    over = Window.partitionBy("conv_id").orderBy("step").rowsBetween(*ends)
    steps = steps.select("conv_id", "step", *[F.coalesce(total(v).over(over), F.lit(0)).alias(f"all_{v}") for v in values])
    inside = Window.partitionBy("conv_id", "step").orderBy("block").rowsBetween(*ends)
    near = rows.select("conv_id", "step", "block", *[F.coalesce(total(v).over(inside), F.lit(0)).alias(v) for v in values])
    both = near.join(steps, ["conv_id", "step"])
    joined = {v: F.col(v).bitwiseXOR(F.col(f"all_{v}")) if total is F.bit_xor else F.col(v) + F.col(f"all_{v}") for v in values}
    return both.select("conv_id", "block", *[joined[v].alias(v) for v in values])


def matrix_rows(turns: DataFrame, block_turns: int) -> DataFrame:
    """Rebuilt conversations in rows of up to block_turns turns.

    conv_id, block, ids, chars, more (the conversation goes on in the next block), q1 and q2 (hashes of all turns of
    earlier blocks), r1 and r2 (the same with this block's).
    """
    depth = F.col("depth")
    block = F.floor((F.greatest(depth, F.lit(1)) - 1) / block_turns).cast("long")
    turn = F.when(depth > 0, F.struct("depth", "id", "chars"))
    hashed = [F.bit_xor(F.when(depth > 0, F.xxhash64(F.lit(k), depth, F.col("id")))) for k in (1, 2)]
    rows = turns.groupBy("conv_id", block.alias("block")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.max("length").alias("length"),
        F.coalesce(hashed[0], F.lit(0)).alias("x1"), F.coalesce(hashed[1], F.lit(0)).alias("x2"),
    )
    more = F.col("length") > (F.col("block") + 1) * block_turns
    rows = written(rows.select("conv_id", "block", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars"), more.alias("more"), "x1", "x2"), "turn-rows")
    deep = rows.where("block > 0 or more").select("conv_id", "block", F.col("x1").alias("q1"), F.col("x2").alias("q2"))
    earlier = _over_blocks(deep, ["q1", "q2"], F.bit_xor, later=False)
    rows = rows.join(earlier, ["conv_id", "block"], "left")
    rows = rows.withColumns({"q1": F.coalesce("q1", F.lit(0)), "q2": F.coalesce("q2", F.lit(0))})
    return rows.withColumns({"r1": F.col("q1").bitwiseXOR(F.col("x1")), "r2": F.col("q2").bitwiseXOR(F.col("x2"))}).drop("x1", "x2")


class _Matrix:
    """The sorted rows of a shard, padded, between the last row of the shard before and the first of the one behind.

    `new[i, d]` marks that row i is the first with its first d turns; it is the OR over all columns up to d of what
    changes from the row above.
    """

    def __init__(self, table: pa.Table, edges: pa.Table):
        rows = table.select([*_ORDER, "chars", "r1", "r2", "later_skipped", "later_leaves", "later_starts"])
        edge = edges.to_pylist()[0] if edges.num_rows else {"above": None, "below": None}
        self.foreign = np.zeros(rows.num_rows, bool)
        for name in ("above", "below"):
            if edge[name] is not None:
                one = {**edge[name], "chars": [0] * len(edge[name]["ids"]), "later_skipped": 0, "later_leaves": 0, "later_starts": 0}
                rows = pa.concat_tables([rows, pa.Table.from_pylist([one], schema=rows.schema)])
                self.foreign = np.append(self.foreign, True)
        ids = rows["ids"].combine_chunks()
        width = np.diff(ids.offsets.to_numpy()) if len(ids) else np.zeros(0, int)
        flat = np.frombuffer(b"".join(ids.flatten().to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
        owner = np.repeat(np.arange(len(width)), width)
        column = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width)
        columns = int(width.max(initial=0))
        matrix = np.zeros((2, len(width), columns), np.uint64)
        matrix[:, owner, column] = flat.T
        chars = np.zeros((len(width), columns + 1), np.int64)
        chars[owner, column + 1] = rows["chars"].combine_chunks().flatten().to_numpy()
        number = {name: rows[name].to_numpy() for name in ("block", "q1", "q2", "r1", "r2", "more", "conv_id", "later_skipped", "later_leaves", "later_starts")}
        keys = [number["conv_id"], number["more"]]
        keys += [matrix[half, :, c] for c in reversed(range(columns)) for half in (1, 0)]
        order = np.lexsort([*keys, number["q2"], number["q1"], number["block"]])
        self.ids, self.chars, self.width, self.foreign = matrix[:, order], chars[order], width[order], self.foreign[order]
        self.number = {name: values[order] for name, values in number.items()}
        n = len(order)
        changed = np.ones((n, columns + 1), bool)
        if n > 1:
            changed[1:, 0] = np.any([self.number[k][1:] != self.number[k][:-1] for k in ("block", "q1", "q2")], axis=0)
            changed[1:, 1:] = (self.ids[:, 1:] != self.ids[:, :-1]).any(axis=0) | (np.arange(1, columns + 1) > self.width[:-1, None])
        self.new = np.logical_or.accumulate(changed, axis=1) & (np.arange(columns + 1) <= self.width[:, None])
        follows = np.zeros(n, bool)  # whether the row below goes on from all of this one
        if n > 1:
            at = np.minimum(self.width[:-1], columns)
            follows[:-1] = (self.width[1:] >= self.width[:-1]) & ~self.new[np.arange(1, n), at]
        self.leaf = ~self.number["more"] & ~follows & ~self.foreign
        skipped = np.where(self.new, 0, self.chars)
        self.skipped = np.cumsum(skipped[:, ::-1], axis=1)[:, ::-1]

    def key(self, row: int, depth: int, block_turns: int) -> bytes:
        """What names a node in all shards; at the end of a block, that of the group which goes on from it."""
        number = self.number
        if depth == block_turns:
            parts = np.array([number["block"][row] + 1, number["r1"][row], number["r2"][row]]).tobytes()
        else:
            parts = np.array([number["block"][row], number["q1"][row], number["q2"][row]]).tobytes() + self.ids[:, row, :depth].tobytes()
        return hashlib.blake2b(parts, digest_size=16).digest()


def _pieces(m: _Matrix, range_no: int, block_turns: int, root: int) -> Iterator[dict]:
    """The nodes of a shard, one depth after another; those that reach into other shards are marked as split."""
    number, own = m.number, ~m.foreign
    above = None  # runs of the depth before: first rows, smallest conversation, whether split
    conv = np.where(own, number["conv_id"], np.iinfo(np.int64).max)
    for depth in range(m.new.shape[1]):
        rows = np.flatnonzero(m.width >= depth)
        starts = np.flatnonzero(m.new[rows, depth])
        if not len(starts):
            break
        add = lambda values: np.add.reduceat(values.astype(np.int64), starts)
        first = rows[starts]
        mine = own[rows]
        ends = mine & (m.width[rows] == depth) & ~number["more"][rows]
        deeper = m.new[rows, depth + 1] if depth + 1 < m.new.shape[1] else np.zeros(len(rows), bool)
        if depth == block_turns:
            deeper = number["later_starts"][rows]
        found = {
            "conv_id": np.minimum.reduceat(conv[rows], starts), "split": np.maximum.reduceat(m.foreign[rows], starts),
            "n_convs": add(mine), "n_children": add(deeper * mine), "n_leaves": add((m.leaf[rows] + number["later_leaves"][rows]) * mine),
            "saved_tokens": add((m.skipped[rows, depth] + number["later_skipped"][rows]) * mine), "n_ends": add(ends),
        }
        wanted = np.flatnonzero((found["n_convs"] > 0) & ((depth > 0) | (number["block"][first] == 0)))
        blocks = number["block"][first]
        out = {name: found[name][wanted] for name in ("split", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")}
        out["depth"] = blocks[wanted] * block_turns + depth
        named = out["split"] | ((depth == block_turns) & (out["n_children"] > 0))
        out["node"] = [m.key(first[i], depth, block_turns) if name else None for i, name in zip(wanted, named)]
        parents, parent_keys = [None] * len(wanted), [None] * len(wanted)
        if depth:
            runs = np.searchsorted(above[0], first[wanted], "right") - 1
            for k, (i, run) in enumerate(zip(wanted, runs)):
                if depth == 1 and blocks[i] == 0:
                    parents[k] = root
                elif depth == 1 or above[2][run]:
                    parent_keys[k] = m.key(first[i], depth - 1, block_turns)
                else:
                    parents[k] = int(above[1][run])
        out["parent_conv_id"], out["parent"] = parents, parent_keys
        hashes, texts = [], []
        done = rows[ends]
        to = np.cumsum(found["n_ends"])
        for i, split in zip(wanted, out["split"]):
            text = b",".join(b"%d" % c for c in number["conv_id"][done[to[i] - found["n_ends"][i] : to[i]]].tolist()) if found["n_ends"][i] else None
            hashes.append(None if split else NOTHING if text is None else hashlib.sha256(text).hexdigest())
            texts.append(text if split else None)
        out["ends_sha256"], out["ends"] = hashes, texts
        out["range_no"] = np.full(len(wanted), range_no)
        above = first, found["conv_id"], found["split"]
        yield out


def _sharded(rows: DataFrame, shard_turns: int) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by ranges of (block, earlier turns, turns, conv_id), and for each range the rows next to it.

    conv_id tells copies apart, so that a sequence that most conversations have spreads over as many ranges as it needs.
    """
    cells = rows.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    ranges = rows.repartitionByRange(max(1, -(-cells // shard_turns)), *_ORDER).withColumn("range_no", F.spark_partition_id())
    ranges = written(ranges, "turn-shards")
    row = F.struct(*_ORDER, "r1", "r2")
    edges = ranges.groupBy("range_no").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    line = Window.orderBy("range_no")
    return ranges, edges.select("range_no", F.lag("last").over(line).alias("above"), F.lead("first").over(line).alias("below"))


def _each_shard(ranges: DataFrame, edges: DataFrame, of_matrix, schema: str) -> DataFrame:
    def shard(table: pa.Table, neighbours: pa.Table) -> pa.Table:
        target = pa.schema(list(_arrow(schema)))
        if not table.num_rows:
            return target.empty_table()
        parts = [pa.Table.from_pydict(part, schema=target) for part in of_matrix(_Matrix(table, neighbours), table["range_no"][0].as_py())]
        return pa.concat_tables(parts)

    return ranges.groupBy("range_no").cogroup(edges.groupBy("range_no")).applyInArrow(shard, schema)


def _arrow(schema: str) -> Iterator[pa.Field]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    for field in schema.split(", "):
        name, kind = field.split()
        yield pa.field(name, kinds[kind])


def _later(rows: DataFrame, shard_turns: int) -> DataFrame:
    """What the blocks behind each block of a long conversation add to its nodes: later_skipped, later_leaves, later_starts.

    In the order of its block, each row starts the nodes that the row above has not, and skips the characters of all
    others; sums over the rows of a node are then sums over its subtree, whatever block that ends in.
    """
    none = {name: F.lit(0).cast("long") for name in ("later_skipped", "later_leaves", "later_starts")}
    ranges, edges = _sharded(rows.where("block > 0").withColumns(none), shard_turns)

    def added(m: _Matrix, range_no: int) -> Iterator[dict]:
        own = ~m.foreign
        yield {
            "conv_id": m.number["conv_id"][own], "block": m.number["block"][own], "later_skipped": m.skipped[own, 0],
            "later_leaves": m.leaf[own].astype(np.int64), "starts": m.new[own, 1].astype(np.int64),
        }

    each = written(_each_shard(ranges, edges, added, "conv_id long, block long, later_skipped long, later_leaves long, starts long"), "turn-later")
    behind = each.unionByName(rows.where("block = 0 and more").select("conv_id", "block", *[F.lit(0).cast("long").alias(c) for c in ("later_skipped", "later_leaves", "starts")]))
    sums = _over_blocks(behind, ["later_skipped", "later_leaves"], F.sum, later=True)
    starts = each.select("conv_id", (F.col("block") - 1).alias("block"), F.col("starts").alias("later_starts"))
    return sums.join(starts, ["conv_id", "block"], "left")


def _ends_hashed(pieces: DataFrame) -> DataFrame:
    """(node, ends_sha256) of split nodes: their lists of conversations, hashed piece by piece in the order of shards."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
        for batch in batches:
            for node, ends in zip(batch["node"], batch["ends"]):
                yield node.as_py(), ends.as_py()

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, parts in groupby(rows_of(batches), lambda row: row[0]):
            digest = hashlib.sha256()
            for k, (_, ends) in enumerate(parts):
                digest.update(b"," + ends if k else ends)
            yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "hashed": [digest.hexdigest()]})

    rows = pieces.where("split and ends is not null").select("node", "range_no", "ends").repartition("node")
    return rows.sortWithinPartitions("node", "range_no").select("node", "ends").mapInArrow(streamed, "node binary, hashed string")


def turn_trie(
    conversations: DataFrame, head_turns: int = HEAD_TURNS, family: int = FAMILY,
    block_turns: int = BLOCK_TURNS, shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """A row for each distinct beginning of the rebuilt conversations.

    conversations: conv_id, turn, role, text. Turns come in order of `turn` (null first), those of one number in the order
    of the MD5 of `<characters of the role>:<role><text>`; null role and text are empty. Conversation c begins with the first
    h turns of conversation c - c % family (all if it has fewer, none if it is absent; % as in SQL), h being the CRC-32
    of its decimal number modulo head_turns, and goes on with its own turns behind its first h. Gives depth, conv_id
    (smallest member), parent_conv_id (the parent's; null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Rows without conv_id are left out, repeated rows are turns of their own, other columns are ignored, an
    empty table gives no rows.

    Texts are not shuffled. Nothing is gathered per conversation or per node: long conversations are cut into rows of
    block_turns turns, shards are ranges of about shard_turns turns that may divide a node or a set of copies, and nodes
    that reach over a border are put together from a piece per shard. Only the hash of a node's ends is sequential by
    nature: a split node's list is streamed through one task, in chunks.
    """
    ready(conversations.sparkSession)
    rows = matrix_rows(rebuilt(turns_of(conversations), head_turns, family), block_turns)
    root = rows.agg(F.min("conv_id"), F.max("block")).first()
    none = {name: F.lit(0).cast("long") for name in ("later_skipped", "later_leaves", "later_starts")}
    if root[1]:
        rows = written(rows, "turn-blocks")
        later = _later(rows, shard_turns)
        rows = rows.join(later, ["conv_id", "block"], "left").withColumns({name: F.coalesce(name, F.lit(0).cast("long")) for name in none})
    else:
        rows = rows.withColumns(none)
    smallest = root[0]
    ranges, edges = _sharded(rows, shard_turns)
    pieces = written(_each_shard(ranges, edges, lambda m, no: _pieces(m, no, block_turns, smallest), PIECE), "trie-pieces")
    sums = [F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = pieces.where("not split").drop("range_no", "split", "ends")
    split = pieces.where("split").groupBy("node").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"),
        F.max("parent_conv_id").alias("parent_conv_id"), *sums,
    )
    split = split.join(_ends_hashed(pieces), "node", "left").withColumn("ends_sha256", F.coalesce("hashed", F.lit(NOTHING))).drop("hashed")
    split = written(split, "trie-split")
    nodes = whole.unionByName(split)
    named = split.select("node", "conv_id").union(whole.where("node is not null").select("node", "conv_id"))
    named = written(named.select(F.col("node").alias("parent"), F.col("conv_id").alias("named")), "trie-parents")
    below = nodes.where("parent is not null").join(named, "parent", "left").withColumn("parent_conv_id", F.col("named"))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return nodes.where("parent is null").select(*columns).union(below.select(*columns))
