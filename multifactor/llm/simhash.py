"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from multifactor.llm.common import quoted, row_hash, stored

BITS = 64
#: XXH64's seed.
HASH_SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the text's word shingles, repeats included: bit b is set if over half the shingle hashes have it."""
    low = (text or "").encode("utf-8", "replace").lower().split()
    if not low:
        return 0
    joined = b" ".join(low)
    ends = np.cumsum([len(w) + 1 for w in low]) - 1
    k = min(words, len(low))
    starts = np.concatenate([[0], ends[: len(low) - k] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * ones > len(hashes)).astype(object)).sum())


def covering_masks(radius: int, seed: int = 42) -> list[int]:
    """2^(radius+1) - 1 masks such that any two values at most ``radius`` bits apart agree on one mask's bits.

    Each bit gets a nonzero vector of radius+1 bits; mask v keeps the bits whose vector has odd parity with v. The
    vectors of at most ``radius`` differing bits do not span the space, so some v is orthogonal to all of them, and its
    mask keeps none of those bits.
    """
    n = 1 << (radius + 1)
    vectors = np.array([1 + i % (n - 1) for i in range(BITS)])
    np.random.default_rng(seed).shuffle(vectors)
    return [sum(1 << i for i in range(BITS) if int(vectors[i] & v).bit_count() & 1) for v in range(1, n)]


def signed(value: int) -> int:
    """The same 64 bits as Spark's long."""
    return value - (1 << 64) if value >> 63 else value


def _chains(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges from each value to its component's first value, components by links of at most ``radius`` bits."""
    bits = values.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = np.arange(len(values))
    while True:
        least = np.where(near, label[None, :], len(values)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return [(int(values[b]), int(values[a])) for a, b in enumerate(label) if a != b]
        label = least


def near_links(values: DataFrame, radius: int = 3, most: int = 1024, seed: int = 42) -> DataFrame:
    """Links (a, b) that join distinct longs ``fp`` into the components of all pairs at most ``radius`` bits apart.

    Values meet in the buckets of the covering masks. A bucket's own links are reduced to one for each value joined, so
    no group's pairs are emitted. Buckets of more than ``most`` values are dealt out again by a second and third family
    of masks inside what the first left free: any close pair of theirs meets again, and as each family halves the free
    bits, of which a bucket of ``most`` values needs log2(most) at least, none is left after a few. No bucket is cut.
    Repeated values count once; an empty table gives no links.
    """
    spark = values.sparkSession
    rows = values.distinct().select("fp", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("kept"))
    found: list[DataFrame] = []

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def joined(buckets: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in _chains(np.sort(held), radius)] for held in buckets], dtype=object)

    level = 0
    while True:
        masks = covering_masks(radius, seed + level)
        tables = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(signed(m)).alias("mask")) for i, m in enumerate(masks)]))
        dealt = rows.select("fp", "path", "kept", tables.alias("t")).select(
            "fp", (F.col("path") * (2 << radius) + F.col("t.i") + 1).alias("path"), F.col("kept").bitwiseOR(F.col("t.mask")).alias("kept"))
        dealt = dealt.withColumn("key", F.col("fp").bitwiseAND(F.col("kept")))
        sizes = dealt.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")  # summed before they move; a large bucket meets its size in a join
        met = stored(dealt.join(sizes, ["path", "key"]))
        small = met.where(F.col("n") <= most).groupBy("path", "key").agg(F.collect_list("fp").alias("held"))
        found.append(small.select(F.explode(joined("held")).alias("e")).select("e.a", "e.b"))
        large = met.where(F.col("n") > most)
        if not large.limit(1).count():
            break
        rows, level = large.select("fp", "path", "kept"), level + 1
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; ``root`` is the least node of its component.

    Alternates large-star and small-star steps until the links stand still: both only join each node's neighbours with
    their least one, so a component is never gathered. Every step is stored, so lost executors cost one step. Repeated
    links count once; no links give no rows.
    """

    def step(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        met = both.join(least, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.where("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")))
        return stored(out.where("a != b").distinct())

    def state(edges: DataFrame):
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = stored(links)
    before = state(edges)
    while before[0]:
        edges = step(step(edges, True), False)
        if (now := state(edges)) == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


@F.pandas_udf(T.LongType())
def fingerprint_long(texts: pd.Series) -> pd.Series:
    """``fingerprint`` of each text as a signed long."""
    return pd.Series([signed(fingerprint(t)) for t in texts], dtype="int64")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """Each row's key, ``h`` (row_hash, seed 42), ``fp`` (its SimHash) and ``component`` (the least key reachable).

    Documents link when their fingerprints differ in at most ``radius`` bits. Null, empty and blank texts have
    fingerprint 0 and link like others; null keys are passed over when the least key is taken (null if there is no
    other); repeated rows each get a row; an empty table gives none.
    """
    slim = stored(docs.select(F.col(quoted(key)).alias("key"), row_hash(docs, 42).alias("h"), fingerprint_long(F.col(quoted(text))).alias("fp")))
    nodes = stored(slim.groupBy("fp").agg(F.min("key").alias("least")))
    roots = components(near_links(nodes.select("fp"), radius))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labelled = stored(labelled)
    least = labelled.groupBy("root").agg(F.min("least").alias("component"))
    named = stored(labelled.join(least, "root").select("fp", "component"))
    return slim.join(named, "fp").select("key", "h", "fp", "component")


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the least key."""
    return keep_first(docs, stored(near_duplicates(docs, key=key, text=text, radius=radius)))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of ``found`` (key, h, fp, component): the one with the least key.

    Rows without a key give way to rows with one; among equal keys the row with the least hash stays, once.
    """
    first = found.groupBy("component", F.when(F.col("component").isNull(), F.col("fp")).alias("alone")).agg(
        F.min(F.struct(F.col("key").isNull().alias("nokey"), "key", "h")).alias("first"))
    kept = stored(first.select("first.h").distinct())
    records = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("record"), row_hash(docs, 42).alias("h"))
    if found.groupBy("h").count().where("count > 1").limit(1).count():  # equal rows: one stays
        records = records.dropDuplicates(["h"])
    return records.join(kept, "h", "left_semi").select("record.*")
