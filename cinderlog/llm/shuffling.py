"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.sources.workspace import new_folder, written

SHARDS, BUCKET_BYTES, SEED = 8, 32 << 20, 10
#: Buckets that a task shuffles one after another; large tables get more tasks.
TASK_BUCKETS = 8


def shuffle_to_shards(
    docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED,
    columns: Sequence[str] = ("doc_id", "text"), path: str | None = None,
) -> DataFrame:
    """Write documents in random order to `shards` folders of Parquet, by the law of rows: counts differ by at most one.

    Pass one scatters rows over buckets of about `bucket_bytes` by a seeded hash of `columns`. Pass two shuffles each
    bucket (Fisher-Yates) with a generator seeded by the bucket's number. Buckets follow one another, so a row's place in
    the whole is the number of rows in earlier buckets plus its place in its own; the places are cut into `shards` runs.

    Rows alike in all columns have one hash and cannot be told apart. Those that are larger together than a bucket are
    counted, each task's own first, and dealt in equal parts to as many buckets as they fill, at even distances; they travel as
    one row with a number of copies and are written out where the bucket is shuffled.

    Gives what was written: `columns`, slot (place in the shard, from 0, gapless), shard. docs needs the columns, none of
    them of a map type; columns named slot or shard are refused, others that are not asked for are left out. Null texts
    and ids are values like any other, and columns that are not strings or binary count as one byte. An empty table gives
    no rows. The same rows, shards and seed give the same shards, whatever their order.
    """
    if clash := {"slot", "shard"} & set(columns):
        raise ValueError(f"columns {sorted(clash)} are added by the operator")
    carried = list(dict.fromkeys([*columns]))
    spread = F.xxhash64(F.lit(seed), *[docs[c] for c in carried])
    texts = [F.coalesce(F.octet_length(docs[c]), F.lit(0)).cast("long") for c in carried if isinstance(docs.schema[c].dataType, (T.StringType, T.BinaryType))]
    sizes = written(docs.select(spread.alias("_spread"), reduce(add, texts, F.lit(1).cast("long")).alias("_size")), "shuffle-sizes")
    rows, amount = sizes.agg(F.count("*"), F.sum("_size")).first()
    buckets = max(1, -(-(amount or 0) // bucket_bytes))
    bucket = F.pmod(F.col("_spread"), F.lit(buckets))
    large = sizes.groupBy("_spread").agg(F.sum("_size").alias("_size")).where(F.col("_size") > bucket_bytes)
    large = written(large.select("_spread", F.least(F.ceil(F.col("_size") / bucket_bytes), F.lit(buckets)).alias("_parts")), "shuffle-large")
    keyed = docs.select(*[docs[c] for c in carried], spread.alias("_spread"))
    alike = keyed.join(large, "_spread").groupBy(*carried, "_spread", "_parts").agg(F.count("*").alias("_alike"))
    part = alike.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    share = F.floor((F.col("_alike") - 1 - F.col("_part") + F.col("_parts")) / F.col("_parts"))
    step = F.floor(F.col("_part") * buckets / F.col("_parts"))
    dealt = part.withColumn("_copies", share).where("_copies > 0").withColumn("_bucket", F.pmod(bucket + step, F.lit(buckets)))
    dealt = written(dealt.select(*carried, "_spread", "_copies", "_bucket"), "shuffle-dealt")
    single = [F.lit(1).cast("long").alias("_copies"), bucket.alias("_bucket")]
    counts = sizes.join(large, "_spread", "left_anti").select(*single).unionByName(dealt.select("_copies", "_bucket"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.groupBy("_bucket").agg(F.sum("_copies").alias("_rows"))
    first = counts.select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    others = keyed.join(large, "_spread", "left_anti").select(*carried, "_spread", *single)
    scattered = others.unionByName(dealt).join(written(first, "shuffle-buckets"), "_bucket")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // TASK_BUCKETS))

    def shuffled(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["_spread"].to_numpy(), kind="stable")
        order = np.repeat(order, table["_copies"].to_numpy()[order])
        np.random.default_rng([seed, key[0].as_py()]).shuffle(order)  # Fisher-Yates
        place = table["_first"][0].as_py() + np.arange(len(order))
        shard = place * shards // rows
        slot = place - -(-shard * rows // shards)
        table = table.select(carried).take(order)
        return table.append_column("slot", pa.array(slot, pa.int64())).append_column("shard", pa.array(shard, pa.int32()))

    schema = docs.select(*carried).schema.add("slot", "long").add("shard", "integer")
    out = path or new_folder(docs.sparkSession, "shards")
    grouped = scattered.repartition(tasks, "_bucket").groupBy("_bucket")
    grouped.applyInArrow(shuffled, schema).write.partitionBy("shard").parquet(out)
    return docs.sparkSession.read.schema(schema).parquet(out)
