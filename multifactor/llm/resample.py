"""Importance resampling towards a target distribution of hashed n-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from multifactor.llm.common import _INSIDE, _LOWER, encoded, free_names, in_chunks, numbered, quoted, row_hash, stored

#: Bytes of texts whose n-grams are interned together (a longer text is interned by itself), and n-grams in one table at most.
CHUNK_BYTES, TABLE_ROOM = 1 << 22, 1 << 20
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64(rows: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each row of a matrix of bytes: short rows by columns for all rows at once, long ones by the library."""
    n, length = rows.shape
    if length > 31:
        return np.fromiter((xxhash.xxh64_intdigest(r.tobytes()) for r in rows), np.uint64, n)
    h, at = np.full(n, _P5 + np.uint64(length), np.uint64), 0
    while at + 8 <= length:
        lane = np.ascontiguousarray(rows[:, at : at + 8]).view("<u8")[:, 0]
        h = _turned(h ^ (_turned(lane * _P2, 31) * _P1), 27) * _P1 + _P4
        at += 8
    if at + 4 <= length:
        lane = np.ascontiguousarray(rows[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64)
        h = _turned(h ^ (lane * _P1), 23) * _P2 + _P3
        at += 4
    for i in range(at, length):
        h = _turned(h ^ (rows[:, i].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


class NgramTable:
    """An open-addressed table of n-grams of one buffer: keys are xxhash64, and equal keys are held against the bytes.

    Slots hold the key, where the n-gram stands first, its bytes' number, its bucket and how often it occurred.
    """

    def __init__(self, data: np.ndarray, room: int):
        size = 1 << max(4, (2 * room - 1).bit_length())
        self.data, self.mask = data, np.uint64(size - 1)
        self.key, self.at, self.length = np.zeros(size, np.uint64), np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.count, self.bucket = np.zeros(size, np.int64), np.zeros(size, np.int64)

    def intern(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The slot of each n-gram, by linear probing, n-grams of equal length together; their occurrences are counted."""
        slots = np.empty(len(starts), np.int64)
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            group = order[a:b]
            slots[group] = self._of_length(starts[group], int(lengths[group[0]]))
        self.count += np.bincount(slots, minlength=len(self.count))
        return slots

    def _of_length(self, starts: np.ndarray, length: int) -> np.ndarray:
        views = np.lib.stride_tricks.sliding_window_view(self.data, length)
        rows = views[starts]
        keys = xxhash64(rows)
        found = (keys & self.mask).astype(np.int64)
        open_rows = np.arange(len(starts))
        while len(open_rows):
            slot = found[open_rows]
            free = self.at[slot] < 0
            self.at[slot[free]] = starts[open_rows[free]]  # of several rows one claims the slot; the others are held against it
            claimed = slot[free]
            self.key[claimed], self.length[claimed] = xxhash64(views[self.at[claimed]]), length
            same = (self.key[slot] == keys[open_rows]) & (self.length[slot] == length)
            hit = np.flatnonzero(same)
            same[hit] = (views[self.at[slot[hit]]] == rows[open_rows[hit]]).all(axis=1)
            open_rows = open_rows[~same]
            found[open_rows] = (found[open_rows] + 1) & int(self.mask)
        return found

    def set_buckets(self, buckets: int) -> None:
        """Fill in each n-gram's bucket, the CRC-32 of its bytes modulo ``buckets``, once for all its occurrences."""
        used, view = np.flatnonzero(self.at >= 0), memoryview(self.data)
        self.bucket[used] = [zlib.crc32(view[a : a + n]) % buckets for a, n in zip(self.at[used].tolist(), self.length[used].tolist(), strict=True)]


def _ngrams(texts: list[bytes], most: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Lower-cased words joined by one space, and (starts, lengths, texts' places) of the n-grams of 1 to ``most`` words."""
    low = _LOWER[np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8)]
    inside = _INSIDE[low]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    first, after = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(ends, first, side="right")
    low[after] = ord(" ")
    inside[after] = True
    data, sizes = low[inside], after - first
    starts = np.cumsum(sizes + 1) - sizes - 1
    grams = []
    for n in range(1, most + 1):
        k = max(0, len(first) - n + 1)
        whole = of[:k] == of[n - 1 : n - 1 + k]
        stops = starts[n - 1 : n - 1 + k] + sizes[n - 1 : n - 1 + k]
        grams.append((starts[:k][whole], (stops - starts[:k])[whole], of[:k][whole]))
    return data, grams


def _interned(texts: list[bytes], most: int, buckets: int) -> Iterator[tuple[int, NgramTable, np.ndarray, np.ndarray]]:
    """(words in an n-gram, table, slot of each occurrence, its text) for at most TABLE_ROOM occurrences at a time."""
    data, grams = _ngrams(texts, most)
    for n, (starts, lengths, of) in enumerate(grams, 1):
        for i in range(0, len(starts), TABLE_ROOM):
            part = slice(i, i + TABLE_ROOM)
            table = NgramTable(data, len(starts[part]))
            slots = table.intern(starts[part], lengths[part])
            table.set_buckets(buckets)
            yield n, table, slots, of[part]


def bucket_counts(docs: DataFrame, text: Column, *, most: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How often n-grams of 1 to ``most`` words of all texts fall into each bucket; each task sends one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = encoded(batch.column(0).to_pylist())
            for a, b in in_chunks(texts, CHUNK_BYTES):
                for _, table, _, _ in _interned(texts[a:b], most, buckets):
                    np.add.at(total, table.bucket, table.count)
        yield pa.RecordBatch.from_pydict({"bucket": np.flatnonzero(total), "n": total[total > 0]})

    counted = docs.select(text.alias("t")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(buckets, np.int64)
    for r in counted:  # at most ``buckets`` rows
        found[r["bucket"]] = r["n"]
    return found


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths: the log of its smoothed share in ``target`` over that in ``source``, rounded down."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, text: Column, gains: np.ndarray, *, most: int = 1) -> DataFrame:
    """``docs`` (columns of any type) with n_words, n_features, and weight, the sum of its n-grams' gains."""
    held = free_names(docs.columns, ["n_words", "n_features", "weight", "weighed_text"])
    kept = docs.select(*[F.col(quoted(c)).alias(held[c]) for c in docs.columns], text.alias("weighed_text"))
    schema = kept.drop("weighed_text").schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(batch.num_columns - 1).to_pylist())
            words, features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for a, b in in_chunks(texts, CHUNK_BYTES):
                for n, table, slots, of in _interned(texts[a:b], most, len(gains)):
                    held = np.bincount(of, minlength=b - a)
                    features[a:b] += held
                    words[a:b] += held if n == 1 else 0
                    np.add.at(weight, a + of, gains[table.bucket][slots])
            columns = [*batch.columns[:-1], pa.array(words), pa.array(features), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return kept.mapInArrow(weigh, schema)


def gumbel(key: Column, seed: int) -> Column:
    """A standard Gumbel draw in thousandths, rounded down, fixed by ``seed`` and the key as text (null: empty text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def resampling_scores(
    docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", most: int = 1, buckets: int = 10_000,
    seed: int = 2024, percent: int = 10, least_words: int = 20,
) -> DataFrame:
    """Stored rows ``key``, ``h`` (row_hash of the row), n_words, n_features, weight, score and rank: one for each row of ``docs``.

    Weight is the sum of the gains of all n-grams of 1 to ``most`` words; score adds a Gumbel draw, so that the rows of
    highest score are a draw without replacement by importance. Of the rows with ``least_words`` words or more,
    ``percent`` in a hundred (rounded down) of highest score have a rank from 1 (equal scores: by key, null first).

    A first pass counts buckets over all texts of ``docs`` and ``target``, a second gathers gains. Each interns n-grams by
    batch in a NgramTable, so that a bucket is found once for equal n-grams, and sums in the task. Ranks are dealt by
    range; texts move nowhere. Null and empty texts have no words, weight 0 and no rank; repeated rows each count and
    may each be drawn, equal ones in any order; an empty table gives none; an empty target gives smoothed shares alone.
    """
    source = bucket_counts(docs, F.col(quoted(text)), most=most, buckets=buckets)
    aimed = bucket_counts(target, F.col(quoted(target_text)), most=most, buckets=buckets)
    slim = docs.select(F.col(quoted(key)).alias("key"), row_hash(docs, seed).alias("h"), F.col(quoted(text)).alias("text"))
    found = weighed(slim.select("key", "h", "text"), F.col("text"), bucket_gains(source, aimed), most=most).drop("text")
    found = stored(found.withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)))
    enough = F.col("n_words") >= least_words
    drawn = percent * found.where(enough).count() // 100
    # equal rows of ``docs`` are equal here: the row's place keeps them apart, so that they need not meet in one task
    placed = found.where(enough).withColumn("place", F.monotonically_increasing_id())
    ranked = numbered(placed, F.desc("score"), F.asc_nulls_first("key"), F.col("place")).drop("place")
    rank = F.when(F.col("nth") < drawn, F.col("nth") + 1)
    return stored(ranked.withColumn("rank", rank).drop("nth").unionByName(found.where(~enough).withColumn("rank", F.lit(None).cast("long"))))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that resampling_scores draws, whole, in no order; repeated rows as often as they are drawn."""
    chosen = resampling_scores(docs, target, **options).where("rank is not null").groupBy("h").agg(F.count("*").alias("drawn"))
    seed = options.get("seed", 2024)
    records = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("record"), row_hash(docs, seed).alias("h")).join(chosen, "h")
    once = records.dropDuplicates(["h"])
    return once.select("record", F.explode(F.sequence(F.lit(1), F.col("drawn").cast("int")))).select("record.*")
