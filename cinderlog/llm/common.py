"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterable
from functools import lru_cache
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlog.sources.workspace import written

#: A word is a run of anything but the six ASCII spaces; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of text that go to Python at once.
BATCH_ROWS, BATCH_BYTES = 400, 8 << 20
_ODD = 0x9E3779B97F4A7C15


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound what each holds at once: whole texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    _ship(spark.sparkContext.applicationId)
    return spark


@lru_cache(maxsize=1)
def _ship(application: str) -> None:
    """Send the package to the workers of an application, once."""
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="cinderlog-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/cinderlog.zip", "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    SparkSession.active().sparkContext.addPyFile(f"{folder}/cinderlog.zip")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others cannot clash with those an operator adds."""
    return df.select(*[df[name] for name in names])


def running_totals(df: DataFrame, by: list[Column], total: str, value: str) -> DataFrame:
    """Add the sum of `value` over all rows up to and including this one, in the order of `by` over the whole table.

    Rows are dealt by range and written with the number of their range; sums of ranges (one row each) then shift the
    sums inside. `by` has to tell rows apart, or tied rows have to be interchangeable.
    """
    ranges = df.repartitionByRange(*by).withColumn("range_no", F.spark_partition_id())
    ranges = written(ranges, "ranges")
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranges.groupBy("range_no").agg(F.sum(value).alias("range_sum"))
    shifts = shifts.select("range_no", F.coalesce(F.sum("range_sum").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("range_no").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranges.withColumn(total, F.sum(value).over(inside)).join(shifts, "range_no")
    return summed.withColumn(total, (F.col(total) + F.col("shift")).cast("long")).drop("range_no", "shift")


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    BOUND = 1 << 16

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 7)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: Iterable[bytes]) -> np.ndarray:
        if len(self) > self.BOUND:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64)


WORD_HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finishing step of a common generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any run of items in O(1) after O(n): sums of item * base^position, modulo 2^64."""

    BASE = np.uint64(0xD6E8FEB86659FD93)
    BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

    def __init__(self, items: np.ndarray):
        n = len(items)
        self.powers = np.ones(n + 1, np.uint64)
        self.backs = np.ones(n + 1, np.uint64)
        self.powers[1:] = self.BASE
        self.backs[1:] = self.BACK
        np.cumprod(self.powers, out=self.powers)
        np.cumprod(self.backs, out=self.backs)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(items * self.powers[:n], out=self.sums[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of items start..end-1, whatever their place."""
        return (self.sums[end] - self.sums[start]) * self.backs[start]

    def without(self, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The hash of items start..end-1 with the one at `at` left out."""
        rest = (self.sums[end] - self.sums[at + 1]) * self.BACK
        return (self.sums[at] - self.sums[start] + rest) * self.backs[start]


def group_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of n items reaches over the links."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        open_ = a != b
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root

