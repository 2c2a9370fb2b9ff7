"""Two-pass external shuffle into shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from multifactor.llm.common import free_names, quoted, row_hash, stored

#: What each record costs in a shard besides its text.
RECORD_BYTES = 16


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (a null text has none) and the fixed cost of a record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def _weight(key: Column, shard: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key, shard.cast("long"))


def shard_documents(
    docs: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text", seed: int = 42, bucket_bytes: int = 4 << 20, task_bytes: int = 512 << 20
) -> DataFrame:
    """Shuffle all records into ``n_shards`` shards.

    Pass 1 scatters: a record goes to the shard whose seeded hash with the key is highest, so key and shard count alone
    decide, and one more shard takes records only into itself. Inside its shard a record goes to one of several buckets
    by a seeded hash of the whole row; their number follows the total size, so that a bucket holds
    about ``bucket_bytes``, however large the table is and however often a row repeats. Pass 2 puts each bucket's records
    in an order that does not depend on how they arrived, and Fisher-Yates shuffles it (Spark's ``shuffle``, seeded).
    Buckets follow each other in a shard. Tasks get several buckets, ``task_bytes`` at most on average.

    Returns one row for each record: ``record`` (struct of all columns of ``docs``, so no name clashes), ``size``,
    ``shard``, ``bucket``, ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (with one shard more).

    Null keys count as one key; null and empty texts have no bytes; repeated rows each get a slot of their own, and where
    they hold over ``bucket_bytes`` together they are dealt out in lots, so that a row which fills a third of the table
    still spreads over its shard's buckets (rows are equal if their 128-bit hashes are); an empty table gives no rows. Reruns over the same rows agree.
    """
    size = record_size(F.col(quoted(text)))
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, math.ceil(total / n_shards / bucket_bytes))
    slim = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("record"), size.alias("size"), F.col(quoted(key)).alias("key"), row_hash(docs, seed + 1).alias("h"))
    rows = _numbered_copies(slim, bucket_bytes)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.struct(_weight(F.col("key"), s, seed).alias("w"), (-s).alias("s"))))
    rows = rows.withColumn("best", best).select(
        "record", "size", "h", "lot",
        (-F.col("best.s")).cast("int").alias("shard"),
        F.when(_weight(F.col("key"), F.lit(n_shards), seed) > F.col("best.w"), F.lit(n_shards)).otherwise(-F.col("best.s")).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 2), "h", "lot"), F.lit(buckets)).alias("bucket"),
    )
    place = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(place), F.lit(0)).alias("offset"))
    )
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / task_bytes))
    shuffled = (
        rows.repartition(min(n_shards * buckets, max(tasks, 4 * n_shards)), "shard", "bucket")
        .sortWithinPartitions("shard", "bucket", "h", "lot")
        .groupBy("shard", "bucket")
        .agg(F.collect_list(F.struct("record", "size", "grown_shard")).alias("held"))
        .select("shard", "bucket", F.shuffle("held", seed).alias("held"))
    )
    return (
        shuffled.join(offsets, ["shard", "bucket"])
        .select("shard", "bucket", "offset", F.posexplode("held").alias("at", "r"))
        .select("r.record", "r.size", "shard", "bucket", (F.col("offset") + F.col("at")).cast("long").alias("slot"), "r.grown_shard")
    )


def _numbered_copies(rows: DataFrame, lot_bytes: int) -> DataFrame:
    """``rows`` (record, size, key, h) with ``lot``, 0 but for equal rows that hold over ``lot_bytes`` together.

    These are dealt out in lots of ``lot_bytes``. One record of theirs goes on with their count and is copied again by
    many tasks, so that a large group is never gathered; other rows stay where they are.
    """
    counts = rows.groupBy("h").agg(F.count("*").alias("n"), F.max("size").alias("size")).where(F.col("n") > F.greatest(F.lit(1), F.floor(lot_bytes / F.col("size"))))
    counts = stored(counts.select("h", "n", F.greatest(F.lit(1), F.floor(lot_bytes / F.col("size"))).cast("long").alias("each")))
    none = F.lit(0).cast("long").alias("lot")
    if not counts.limit(1).count():
        return rows.select("*", none)
    other = rows.join(counts.select("h"), "h", "left_anti").select(*rows.columns, none)
    one = stored(rows.join(counts.select("h"), "h", "left_semi").groupBy("h").agg(*[F.first(c).alias(c) for c in ("record", "size", "key")]))
    lots = counts.select("h", "n", "each", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("each")))).alias("lot"))
    lots = stored(lots.repartition("h", "lot"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("each"), F.col("n") - F.col("lot") * F.col("each"))))
    return other.unionByName(lots.join(one, "h").select(*rows.columns, "lot", copies.alias("copy")).drop("copy"))


def write_shards(sharded: DataFrame, path: str, *, shard: str = "shard", slot: str = "_slot") -> None:
    """Write the shards as one folder each (``shard=N``), every bucket one sorted run of slots.

    A column of the records that is called as ``shard`` or ``slot`` are gets underscores after its name until it differs
    from all others. Rows without a text are written like others, repeated rows each; an empty table writes no shard.
    """
    names = sharded.schema["record"].dataType.names
    held = free_names(names, [shard, slot, "bucket"])
    out = sharded.select(*[F.col(f"record.{quoted(c)}").alias(held[c]) for c in names], F.col("slot").alias(slot), F.col("shard").alias(shard), F.col("bucket").alias("bucket"))
    (
        out.repartition(shard, "bucket").sortWithinPartitions(shard, "bucket", slot).drop("bucket")
        .write.partitionBy(shard).parquet(path)
    )
