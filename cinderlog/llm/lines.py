"""Removing repeated lines, also those in which one word differs, by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.bytewords import ByteWords
from cinderlog.llm.common import Rolling, mixed, ready, running_totals
from cinderlog.sources.workspace import written

#: Lines of fewer words are compared on equality alone.
MIN_WORDS = 5
#: Fixed odd numbers that keep hashes of different kinds apart.
_SECOND, _LENGTH, _PLACE, _PREFIX, _SUFFIX, _DELETED = (
    np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
)
LINE = "doc_id long, text_key long, line_no int, n_words int, h1 long, h2 long, halves array<long>"


def where_in() -> Column:
    """The place of a line; places sort as lines come."""
    return F.struct("doc_id", "text_key", "line_no")


class _Lines:
    """The lines of a batch of texts with rolling hashes over all their words."""

    def __init__(self, texts: pa.Array):
        words = ByteWords(texts)
        breaks = np.flatnonzero(words.data == 10)
        before = np.searchsorted(breaks, words.offsets)
        self.per_text = np.diff(before) + 1
        first = np.cumsum(self.per_text) - self.per_text
        line = first[words.text_no] + np.searchsorted(breaks, words.start) - before[words.text_no]
        self.words = np.bincount(line, minlength=int(self.per_text.sum()))
        hashes = words.hash
        self.end = np.cumsum(self.words)
        self.start = self.end - self.words
        self.roll = Rolling(mixed(hashes))
        self.second = Rolling(mixed(hashes ^ _SECOND))
        self.text_no = np.repeat(np.arange(len(texts)), self.per_text)
        self.line_no = np.arange(len(self.words)) - np.repeat(first, self.per_text)
        size = self.words.astype(np.uint64) * _LENGTH
        self.h1 = mixed(self.roll.run(self.start, self.end) + size).view(np.int64)
        self.h2 = mixed(self.second.run(self.start, self.end) + size).view(np.int64)

    def halves(self) -> np.ndarray:
        """Four keys per line: of its first and last half, and of the halves that it would have with a word less.

        Two lines within one word of each other agree in a first or last half of the shorter one.
        """
        keys = []
        for n in (self.words // 2, np.maximum(self.words - 1, 0) // 2):
            size = n.astype(np.uint64) * _LENGTH
            keys.append(mixed(self.roll.run(self.start, self.start + n) + size + _PREFIX))
            keys.append(mixed(self.roll.run(self.end - n, self.end) + size + _SUFFIX))
        return np.stack(keys, axis=1).view(np.int64)


def line_keys(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row of LINE for each line of each text; halves are null for lines of fewer than min_words words, h1 and h2 for blank ones."""
    ready(docs.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = _Lines(batch["text"])
            short, blank = lines.words < min_words, lines.words == 0
            halves = lines.halves()
            offsets = pa.array(np.arange(len(short) + 1, dtype=np.int32) * 4)
            rows = pa.array(lines.text_no)
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].take(rows), batch["text_key"].take(rows), pa.array(lines.line_no, pa.int32()),
                pa.array(lines.words, pa.int32()), pa.array(lines.h1, mask=blank), pa.array(lines.h2, mask=blank),
                pa.ListArray.from_arrays(offsets, pa.array(halves.ravel()), mask=pa.array(short)),
            ], ["doc_id", "text_key", "line_no", "n_words", "h1", "h2", "halves"])

    return _keyed(docs).where("text is not null").mapInArrow(keys, LINE)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"), docs["text"].alias("text"))


def variants(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The deletion neighbourhoods of the wanted lines: doc_id, text_key, lines (array of line_no, number, head, tail).

    Gives per line its words' text and keys: `swaps`, one per word, shared by lines that differ in that word alone;
    `whole`, and `deletions`, that of the line without a word: lines of which one has a word more share them crosswise.
    A line that shares only its first half (head) with others can differ from them only behind it, and only words there
    are left out; likewise for its last half (tail).
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            asked = batch["lines"].to_pylist()
            picked = ["\n".join(_picked(text, one)) for text, one in zip(batch["text"].to_pylist(), asked)]
            asked = [line for one in asked for line in one]
            lines = _Lines(pa.array(picked, pa.string()))
            words = lines.words
            half = np.maximum(words - 1, 0) // 2
            head, tail = (np.array([line[side] for line in asked], bool) for side in ("head", "tail"))
            owner = np.repeat(np.arange(len(words)), words)
            at = np.arange(len(owner))
            place = at - lines.start[owner]
            open_ = (head[owner] & (place >= half[owner])) | (tail[owner] & (place < (words - half)[owner]))
            owner, at, place = owner[open_], at[open_], place[open_].astype(np.uint64)
            rest = lines.roll.without(lines.start[owner], lines.end[owner], at)
            size = words[owner].astype(np.uint64)
            swaps = mixed(rest + size * _LENGTH + (place + np.uint64(1)) * _PLACE)
            deletions = mixed(rest + (size - np.uint64(1)) * _LENGTH + _DELETED)
            whole = mixed(lines.roll.run(lines.start, lines.end) + words.astype(np.uint64) * _LENGTH + _DELETED)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]).astype(np.int32))
            content = [" ".join(_words(line)) for text in picked for line in text.split("\n")]
            yield pa.RecordBatch.from_arrays([
                pa.array([line["number"] for line in asked], pa.int64()), pa.array(lines.h1), pa.array(content), pa.array(whole.view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(swaps.view(np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array(deletions.view(np.int64))),
            ], ["number", "h1", "content", "whole", "swaps", "deletions"])

    asked = wanted.selectExpr("doc_id as w_doc", "text_key as w_key", "lines")
    texts = _keyed(docs).join(asked, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("text_key") == F.col("w_key")))
    return texts.select("text", "lines").mapInArrow(expand, "number long, h1 long, content string, whole long, swaps array<long>, deletions array<long>")


def _picked(text: str, lines: list[dict]) -> list[str]:
    parts = text.split("\n")
    return [parts[line["line_no"]] for line in lines]


def _words(line: str) -> list[str]:
    return [word.decode() for word in line.encode().split()]


def within_one_word(a: str, b: str) -> bool:
    """Whether the edit distance of two lines, counted in words, is at most one."""
    x, y = a.split(" "), b.split(" ")
    if abs(len(x) - len(y)) > 1:
        return False
    n = min(len(x), len(y))
    head = next((i for i in range(n) if x[i] != y[i]), n)
    tail = next((i for i in range(n - head) if x[-1 - i] != y[-1 - i]), n - head)
    return max(len(x), len(y)) - head - tail <= 1


def _verified(links: DataFrame) -> DataFrame:
    """Links whose two lines really are within one word."""

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return a.combine(b, within_one_word)

    return links.where(close("content", "keeper_content"))


def _sided(halves: Column, kind: int) -> Column:
    return F.transform(F.array_distinct(halves), lambda half: F.struct(half.alias("half"), F.lit(kind).alias("kind")))


def near_lines(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """(h1, h2, keeper) for distinct lines that have an earlier one within one word; keeper is the earliest such.

    First the lines that share half of themselves with another are found, which all near lines do; only those are
    numbered, in the order of their places, and expanded. Each key then meets the smallest number that has it, so no two
    lines of a group are ever paired with each other.
    """
    distinct = keyed.where("halves is not null").groupBy("h1", "h2").agg(F.min(where_in()).alias("place"), F.first("halves").alias("halves"))
    distinct = written(distinct, "distinct-lines")
    sides = [_sided(F.array(F.col("halves")[kind], F.col("halves")[kind + 2]), kind) for kind in (0, 1)]
    halves = distinct.select("h1", F.explode(F.concat(*sides)).alias("side")).select("h1", "side.*")
    shared = halves.groupBy("half").count().where("count > 1").select("half")
    sharing = halves.join(shared, "half", "left_semi").groupBy("h1")
    sharing = sharing.agg(F.max(F.col("kind") == 0).alias("head"), F.max(F.col("kind") == 1).alias("tail"))
    asked = distinct.join(sharing, "h1").select("place.*", "h1", "h2", "head", "tail", F.lit(1).alias("one"))
    order = [F.col(name) for name in ("doc_id", "text_key", "line_no", "h1", "h2")]
    asked = written(running_totals(asked, order, "number", "one"), "shared-halves")
    line = F.struct("line_no", "number", "head", "tail")
    expanded = variants(docs, asked.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(line)).alias("lines")))
    expanded = written(expanded, "line-variants")
    swaps = expanded.select(F.explode("swaps").alias("key"), F.lit(0).alias("role"), "number")
    shorter = expanded.select(F.col("whole").alias("key"), F.lit(1).alias("role"), "number")
    longer = expanded.select(F.explode(F.array_distinct("deletions")).alias("key"), F.lit(2).alias("role"), "number")
    every = swaps.union(shorter).union(longer)
    least = [F.min(F.when(F.col("role") == role, F.col("number"))).alias(f"least{role}") for role in range(3)]
    earliest = every.groupBy("key").agg(*least, F.count("*").alias("n")).where("n > 1")
    facing = F.when(F.col("role") == 0, F.col("least0")).when(F.col("role") == 1, F.col("least2")).otherwise(F.col("least1"))
    links = every.join(earliest, "key").select("number", facing.alias("keeper")).where("keeper < number")
    links = written(links.groupBy("number").agg(F.min("keeper").alias("keeper")), "near-numbers")
    contents = expanded.select("number", "content").dropDuplicates(["number"])
    both = links.join(contents, "number").join(contents.selectExpr("number keeper", "content keeper_content"), "keeper")
    places = asked.select(F.col("number").alias("keeper"), where_in().alias("place"))
    checked = _verified(both).select("number", "keeper").join(asked.select("number", "h1", "h2"), "number").join(places, "keeper")
    return checked.select("h1", "h2", F.col("place").alias("keeper"))


def line_decisions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """For each line of each document whether it is kept: doc_id, text_key, line_no, n_words, kept, keeper_doc_id, keeper_line_no.

    docs: doc_id, text. A line is what stands between newlines; its words are what stands between ASCII spaces. Lines
    come in the order of doc_id (null first), then of a hash of the text (for rows that share a doc_id), then of their
    number. A line of at least min_words words goes if an earlier one has the same words, or the same but for one word
    changed, left out or put in; the keeper is the earliest such line (which may itself go in favour of a still earlier
    one). A line of fewer words goes if an earlier one has the same words. Lines without words stay, as their own keepers. Null texts have no lines, empty ones have one of no words. Rows alike
    in id and text get the same decisions. An empty table gives no rows.
    """
    keyed = written(line_keys(docs, min_words), "line-keys")
    near = written(near_lines(docs, keyed), "near-lines")
    first = keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.min(where_in()).alias("first"))
    known = first.join(near, ["h1", "h2"], "left").select("h1", "h2", "first", F.coalesce("keeper", "first").alias("keeper"))
    rows = keyed.drop("halves").join(known, ["h1", "h2"], "left")
    keeper = F.coalesce("keeper", where_in())
    return rows.select(
        "doc_id", "text_key", "line_no", "n_words", keeper.eqNullSafe(where_in()).alias("kept"),
        keeper["doc_id"].alias("keeper_doc_id"), keeper["line_no"].alias("keeper_line_no"),
    )


def without_repeats(docs: DataFrame, decisions: DataFrame, measure: str | None = "n_chars") -> DataFrame:
    """Documents without the lines that go, with the columns of docs; documents of which nothing is left go as a whole.

    `measure` names a column that holds the length of the text and is set anew, if docs has it.
    """
    gone = decisions.where("not kept").groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key"), "_gone")
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    rows = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key")), "left")
    left = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col("_gone"), i))
    rows = rows.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    rows = rows.where(F.col("_gone").isNull() | (F.trim(F.translate("text", "\n\t\r\x0b\x0c", "     ")) != ""))
    if measure and measure in docs.columns:
        rows = rows.withColumn(measure, F.when(F.col("_gone").isNull(), F.col(measure)).otherwise(F.char_length("text").cast(docs.schema[measure].dataType)))
    return rows.select(*docs.columns)
