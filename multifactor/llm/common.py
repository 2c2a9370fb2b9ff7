"""What the corpus operators share: reading tables, stored intermediate tables, word rules, hashed words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Words are runs of anything but space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a new local folder only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext
    if app.master.startswith("local-cluster") or not app.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app.applicationId not in _own_dirs:
        _own_dirs[app.applicationId] = tempfile.mkdtemp(prefix="spark-stored-")
    return f"file://{_own_dirs[app.applicationId]}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and no reader computes it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column, name: str = "nth") -> DataFrame:
    """``df`` with ``name``, each row's rank from 0 by ``order``: dealt by range and counted by part, so no task holds all.

    Rows that are equal in ``order`` are ranked among themselves in any order, and meet in one task.
    """
    spare = free_names(["part", "past", "inner"], df.columns)
    part, past, inner = spare["part"], spare["past"], spare["inner"]
    dealt = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    parts = dealt.groupBy(part).agg(F.count("*").alias("m")).select(part, F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias(past))
    inside = F.row_number().over(W.partitionBy(part).orderBy(*order)) - 1
    ranked = dealt.withColumn(inner, inside).join(F.broadcast(parts), part)
    return ranked.select(*[F.col(quoted(c)) for c in df.columns], (F.col(past) + F.col(inner)).alias(name))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part`` modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def bounded_labels(labels: DataFrame, label: str, most: int, key: str = "doc_id") -> DataFrame:
    """(key, label) of at most about ``most`` labelled keys, small enough to broadcast; a key's largest label counts.

    Where there are more, a hash of the key picks them, the same in every run.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    count = known.count()
    if count > most:
        known = known.where(F.pmod(F.xxhash64(F.lit(9), key), F.lit(1 << 30)) < int((1 << 30) * most / count))
    return F.broadcast(known)


def has_map(kind: T.DataType) -> bool:
    """True if a value of this type cannot be hashed or ordered."""
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return has_map(kind.elementType)
    return isinstance(kind, T.MapType | T.VariantType)


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, for F.col."""
    return "`" + name.replace("`", "``") + "`"


def free_names(names: list[str], taken: list[str]) -> dict[str, str]:
    """Each of ``names``, with underscores after it where it clashes with ``taken`` or an earlier one (case does not count)."""
    used, found = {t.lower() for t in taken}, {}
    others = {n.lower() for n in names}
    for name in names:
        new = name
        while new.lower() in used or (new != name and new.lower() in others):
            new += "_"
        used.add(new.lower())
        found[name] = new
    return found


def with_results(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` with new columns; a column of ``docs`` of the same name stays, with underscores after its name."""
    held = free_names(docs.columns, list(columns))
    return docs.select(*[F.col(quoted(c)).alias(held[c]) for c in docs.columns], *[value.alias(name) for name, value in columns.items()])


def row_hash(docs: DataFrame, seed: int) -> Column:
    """A 128-bit hash, as a struct of two longs, of all columns that can be hashed.

    Operators that join results back to whole rows know a row by it: two different rows of a trillion share one with a
    probability of about 1e-15.
    """
    columns = [F.col(quoted(f.name)) for f in docs.schema.fields if not has_map(f.dataType)]
    return F.struct(F.xxhash64(F.lit(seed), *columns).alias("one"), F.xxhash64(F.lit(seed + (1 << 20)), *columns).alias("two"))


_POWER = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = True


def hashed_words(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased alphanumeric words of several texts at once.

    Returns 64-bit hashes (a row for the words, then one for each prefix length in bytes; a shorter word stands for its
    prefix), each word's first byte and the byte after it (within its own text), and for each text the number of words
    before it (one more entry than texts).
    """
    raw = np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8)
    low = _LOWER[raw]
    inside = _INSIDE[low]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    first, after = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    before = np.searchsorted(first, np.concatenate([[0], ends]))
    if not len(first):
        return np.zeros((1 + len(prefixes), 0), np.uint64), first, after, before
    spans, sizes = np.flatnonzero(inside), after - first
    powers = _POWER[(spans - np.repeat(first, sizes)) & 255]
    powers *= low[spans].astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(powers, dtype=np.uint64)])
    begin = np.cumsum(sizes) - sizes
    rows = [sums[begin + sizes] - sums[begin]]
    for k in prefixes:
        rows.append(np.where(sizes > k, sums[begin + np.minimum(k, sizes)] - sums[begin] + np.uint64(k), rows[0]))
    hashes = np.stack(rows)
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(29)
    shift = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(before))
    return hashes, first - shift, after - shift, before


def in_chunks(texts: list[bytes], most: int):
    """Index ranges of consecutive texts with at most ``most`` bytes together, or one longer text."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > most:
            yield start, i
            start, total = i, 0
        total += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def encoded(texts) -> list[bytes]:
    """UTF-8 bytes of each text; nulls are empty."""
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
