"""Fixity audit of archived records: trees of digests over two replicas, compared from the root down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.sources.workspace import written

RANGE_BYTES, FAN = 1 << 16, 16
#: Archive files are about this large; a small archive has LEAST_FILES of them all the same.
FILE_BYTES, LEAST_FILES = 1 << 26, 256


def archived(pages: DataFrame, files: int | None = None) -> DataFrame:
    """Pages as WARC resource records dealt to files: warc_file, page_id, record.

    pages: page_id, url, html. The file is named by the first eight hex digits of the MD5 of page_id, modulo the number of
    files, which follows from the bytes of all records unless it is given. Nulls are written as empty strings.
    """
    text = [F.coalesce(pages[name].cast("string"), F.lit("")) for name in ("url", "page_id", "html")]
    body = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), text[0], F.lit("\r\nWARC-Record-ID: <urn:page:"), text[1],
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text[2]).cast("string"), F.lit("\r\n\r\n"), text[2], F.lit("\r\n\r\n"),
    )
    if files is None:
        amount = pages.select(F.octet_length(body).cast("long").alias("length")).agg(F.sum("length")).first()[0] or 0
        files = max(LEAST_FILES, -(-amount // FILE_BYTES))
    number = F.conv(F.substring(F.md5(text[1].cast("binary")), 1, 8), 16, 10).cast("long") % files
    return pages.select(number.cast("int").alias("warc_file"), pages["page_id"], body.alias("record"))


def laid_out(records: DataFrame) -> DataFrame:
    """Records one after another in their files, by page_id, then by digest: page_id, warc_file, length, digest, offset.

    The digest is of the record's bytes. Only lengths and digests are shuffled; a file's records are ordered in one task.
    """
    lengths = records.select("page_id", "warc_file", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    before = Window.partitionBy("warc_file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return lengths.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def warc_records(pages: DataFrame, files: int | None = None) -> DataFrame:
    """Pages as the records of an archive: page_id, warc_file, length, digest, offset."""
    return laid_out(archived(pages, files))


def leaves(records: DataFrame) -> DataFrame:
    """Leaves of the tree: a record's digest bound to its place."""
    bound = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.col("digest")), 256)
    return records.select("warc_file", "offset", "length", "digest", bound.alias("hash"))


def levels_for(size: int, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> int:
    """Levels (two at least) so that no node of a file of this size has more than `fan` children, the root included."""
    levels, nodes = 2, -(-size // range_bytes)
    while nodes > fan:
        levels, nodes = levels + 1, -(-nodes // fan)
    return levels


def tree(records: DataFrame, levels: int, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> list[DataFrame]:
    """Levels of the digest tree of each file, from ranges of offsets up to the root: (warc_file, node, hash), written.

    Level 0 hashes the records that begin in a range of range_bytes bytes, in order of offset; each further level
    hashes `fan` neighbouring ranges, and the last the whole file. A node's children are bounded by range_bytes and fan.
    """
    ordered = F.array_sort(F.collect_list(F.struct("part", "hash")))
    joined = F.sha2(F.concat_ws("", F.transform(ordered, lambda x: F.concat_ws("=", x["part"].cast("string"), x["hash"]))), 256)
    rows = leaves(records).select("warc_file", F.floor(F.col("offset") / range_bytes).cast("long").alias("node"), F.col("offset").alias("part"), "hash")
    found = []
    for level in range(levels):
        rows = written(rows.groupBy("warc_file", "node").agg(joined.alias("hash")), f"tree-{level}")
        found.append(rows)
        upper = F.lit(0).cast("long") if level + 2 == levels else F.floor(F.col("node") / fan).cast("long")
        rows = rows.select("warc_file", upper.alias("node"), F.col("node").alias("part"), "hash")
    return found


def audit(first: DataFrame, second: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """Where two replicas differ: warc_file, offset, first_length, second_length, first_digest, second_digest, status.

    Each replica is a table of records: warc_file, offset, length, digest (of the record's bytes). Trees are built for
    both and their roots compared; only below nodes that differ are children looked at, level by level, until single
    records are found: `changed`, `missing` (in the second) or `extra`. Files that one replica lacks differ at the root.
    Equal replicas and empty tables give no rows. Offsets tell the records of a file apart; repeated rows count as one,
    and rows with a null file, offset, length or digest have no place in a file and are left out. Columns besides these
    are ignored. No node holds more than a range's records or `fan` children: the largest file sets the number of levels,
    and hot files spread over their ranges. Records behind one that is lost, longer or shorter lie elsewhere in the second
    replica, and are reported so.
    """
    keep = ("warc_file", "offset", "length", "digest")
    first, second = (written(side.select(*keep).dropna().distinct(), "replica") for side in (first, second))
    size = max(side.agg(F.max(F.col("offset") + F.col("length"))).first()[0] or 0 for side in (first, second))
    levels = levels_for(size, range_bytes, fan)
    a, b = tree(first, levels, range_bytes, fan), tree(second, levels, range_bytes, fan)
    bad = None
    for level in reversed(range(levels)):
        left, right = a[level], b[level]
        if bad is not None:
            up = F.lit(0).cast("long") if level + 2 == levels else F.floor(F.col("node") / fan).cast("long")
            left, right = (side.withColumn("up", up).join(bad, ["warc_file", "up"], "left_semi").drop("up") for side in (left, right))
        both = left.withColumnRenamed("hash", "hash_a").join(right.withColumnRenamed("hash", "hash_b"), ["warc_file", "node"], "full")
        bad = both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("warc_file", F.col("node").alias("up"))
        bad = written(bad, f"differing-{level}")
    own = F.floor(F.col("offset") / range_bytes).cast("long")
    left, right = (side.withColumn("up", own).join(bad, ["warc_file", "up"], "left_semi") for side in (first, second))
    left = left.select("warc_file", "offset", F.col("length").alias("first_length"), F.col("digest").alias("first_digest"))
    right = right.select("warc_file", "offset", F.col("length").alias("second_length"), F.col("digest").alias("second_digest"))
    found = left.join(right, ["warc_file", "offset"], "full")
    same = F.col("first_digest").eqNullSafe(F.col("second_digest")) & F.col("first_length").eqNullSafe(F.col("second_length"))
    return found.where(~same).withColumn("status", _status())


def _status() -> Column:
    lost, new = F.col("second_digest").isNull(), F.col("first_digest").isNull()
    return F.when(lost, "missing").when(new, "extra").otherwise("changed")
