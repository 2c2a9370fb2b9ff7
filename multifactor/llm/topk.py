"""Exact top-k inner products over an impact-ordered index, score at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from multifactor.llm.common import quoted, stored

#: Vectors in one index block.
BLOCK_ROWS = 8192
#: Bytes of queries that are sent to all blocks at once; more queries take more passes over the index.
QUERY_BYTES = 32 << 20
#: Queries that share one scan: their sums lie side by side, so a posting is read once for all.
TOGETHER = 128
#: Vectors of which the first bar of a query is the k-th best score.
FIRST_ROWS = 512
#: Quantised impacts in each dimension.
LEVELS = 16
#: Shares of the segments after which the bounds are looked at.
LOOKS = (0.0, 0.5, 0.75, 0.875, 1.0)
#: The scan stops when at most one in so many vectors can still be a member: to rescore them costs less than to go on.
FEW = 4


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as double; null if the vector or a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * factor)))


class ImpactIndex:
    """Posting segments of a block of integer vectors: one for each dimension and quantised value, in numpy."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None):
        """Build the index; ``order`` (see ``packed``) saves the sorting of the postings."""
        self.ids, self.vectors = ids, vectors
        self.largest = float(np.abs(vectors).max(initial=0))
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        step = np.maximum(1, -(-(high - low + 1) // LEVELS))
        level = (vectors - low) // step
        self.low = low[:, None] + step[:, None] * np.arange(LEVELS)  # least and largest value of each segment
        self.high = np.minimum(self.low + step[:, None] - 1, high[:, None])
        self.low = np.minimum(self.low, high[:, None])
        self.order = np.argsort(level, axis=0, kind="stable").T.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32) if order is None else order
        self.cut = np.stack([np.concatenate([[0], np.cumsum(np.bincount(level[:, d], minlength=LEVELS))]) for d in range(vectors.shape[1])])

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Ids, vectors and the order of the postings as bytes."""
        return self.ids.astype(np.int64).tobytes(), self.vectors.astype(np.int64).tobytes(), np.ascontiguousarray(self.order).tobytes()

    @staticmethod
    def unpacked(ids: bytes, vectors: bytes, order: bytes) -> ImpactIndex:
        """The index that ``packed`` gave."""
        held = np.frombuffer(ids, np.int64)
        postings = np.frombuffer(order, np.uint16 if len(held) <= 1 << 16 else np.uint32)
        return ImpactIndex(held, np.frombuffer(vectors, np.int64).reshape(len(held), -1), postings.reshape(-1, len(held)))

    def _scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return inner_products(self.vectors[rows], query[None, :])[:, 0]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, bars: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of the block's ``k`` best vectors, ties to the smaller id; ``own`` ids are no candidates.

        Segments come by descending impact: the most that a member gains over the worst value of the dimension, for
        whichever of the queries gains most. A vector's sum is a lower bound of its score; the segments' widths and, in
        each dimension, the largest impact still to come bound what is missing. ``bars`` are scores that ``k`` vectors
        elsewhere are known to reach: vectors below them are no members. A query that no vector of the block can be a
        member for is done, before the scan or at a later look. The scan stops when for every query few vectors can
        still reach the bar or the k-th best lower bound; these are rescored exactly, so no member can be lost.
        """
        n, none = len(self.ids), np.iinfo(np.int64).min // 2
        bars = np.full(len(queries), none, np.int64) if bars is None else bars
        filled = np.diff(self.cut, axis=1) > 0
        found = [(self.ids[:0], np.zeros(0, np.int64))] * len(queries)
        a, b = queries[:, :, None] * self.low, queries[:, :, None] * self.high  # query, dimension, level
        least, most = np.minimum(a, b), np.maximum(a, b)
        base = np.where(filled, least, np.iinfo(np.int64).max).min(axis=2)
        reach = np.where(filled, most, np.iinfo(np.int64).min).max(axis=2).sum(axis=1)
        at_work = np.flatnonzero(reach >= bars)  # the block's best possible score of each query
        queries, own, bars, least, most, base = queries[at_work], own[at_work], bars[at_work], least[at_work], most[at_work], base[at_work]
        if not len(at_work):
            return found
        impact, gain = most - base[:, :, None], least - base[:, :, None]
        width = np.where(filled, most - least, 0).max(axis=2).sum(axis=1)
        floor = base.sum(axis=1)  # sums count from here
        span = 4 * self.largest * float(np.abs(queries).max(initial=0)) * queries.shape[1]
        kind = np.int32 if span < 2**31 else np.int64
        sums = np.zeros((n, len(queries)), kind)
        gain = np.ascontiguousarray(gain.transpose(1, 2, 0).astype(kind))
        out_of_play = self.ids[:, None] == own[None, :]
        free = n - out_of_play.sum(axis=0)
        dims, levels = np.nonzero(filled)
        order = np.argsort(-impact[:, dims, levels].max(axis=0), kind="stable")
        dims, levels = dims[order], levels[order]
        at, possible = 0, np.ones((n, len(queries)), bool)
        for share in LOOKS:
            upto = int(np.ceil(share * len(dims)))
            for d, s in zip(dims[at:upto].tolist(), levels[at:upto].tolist(), strict=True):
                sums[self.order[d, self.cut[d, s] : self.cut[d, s + 1]]] += gain[d, s]
            at = upto
            waiting = np.zeros(filled.shape, bool)
            waiting[dims[at:], levels[at:]] = True
            missing = np.where(waiting, impact, 0).max(axis=2).sum(axis=1)
            known = np.maximum(bars - floor, none)
            if at:
                lower = np.where(out_of_play, np.iinfo(kind).min, sums).T
                bar = np.array([np.partition(row, n - min(k, n))[n - min(k, n)] for row in lower], np.int64)
                known = np.maximum(known, np.where(free >= k, bar, none))
            possible = (sums + (width + missing)[None, :] >= known[None, :]) & ~out_of_play
            if possible.sum(axis=0).max() <= max(4 * k, n // FEW):
                break
            left = possible.any(axis=0)
            if 2 * left.sum() < len(left):  # the others are done: go on with fewer columns
                keep = np.flatnonzero(left)
                at_work, queries, bars, floor, width, free = at_work[keep], queries[keep], bars[keep], floor[keep], width[keep], free[keep]
                sums, possible, out_of_play, impact, gain = sums[:, keep], possible[:, keep], out_of_play[:, keep], impact[keep], np.ascontiguousarray(gain[:, :, keep])
                if not len(keep):
                    break
        for j, query in enumerate(queries):
            rows = np.flatnonzero(possible[:, j])
            exact = self._scores(rows, query)
            rows, exact = rows[exact >= bars[j]], exact[exact >= bars[j]]
            best = np.lexsort((self.ids[rows], -exact))[:k]
            found[at_work[j]] = (self.ids[rows[best]], exact[best])
        return found


def inner_products(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products, a row for each vector; by floating point where no sum can leave its whole numbers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (vectors.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    return vectors @ queries.T


def _indexed(rows: DataFrame) -> DataFrame:
    """Rows (id, v) in blocks of about BLOCK_ROWS, each one a stored ImpactIndex: (dims, ids, vectors, postings) as bytes."""
    n = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")).withColumn("dims", F.size("v"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        ids, vectors, postings = ImpactIndex(part["id"].to_numpy(np.int64), np.array(part["v"].tolist(), np.int64)).packed()
        return pd.DataFrame({"block": part["block"][:1], "dims": part["dims"][:1], "ids": [ids], "vectors": [vectors], "postings": [postings]})

    return stored(dealt.groupBy("block", "dims").applyInPandas(pack, "block int, dims int, ids binary, vectors binary, postings binary"))


class _Asked:
    """Queries of one length that a pass sends to all blocks: ids, vectors, and the score that each one's members reach at least."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, first: tuple[np.ndarray, np.ndarray] | None, k: int):
        self.ids, self.vectors = ids, vectors
        self.bars = np.full(len(ids), np.iinfo(np.int64).min // 2, np.int64)
        if first is not None:
            for i in range(0, len(ids), 1024):
                scores = inner_products(first[1], vectors[i : i + 1024])
                own = first[0][:, None] == ids[None, i : i + 1024]
                scores = np.where(own, np.iinfo(np.int64).min // 2, scores)
                if len(scores) >= k:
                    self.bars[i : i + 1024] = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 5, *, key: str = "vec_id", vector: str = "v") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest inner products among all rows but those of its own id.

    ``rows`` and ``queries`` hold a long key and an array of longs (see ``scaled``); rows with a null vector, null key or
    no components take no part; a query meets vectors of its own length. Rows are dealt into blocks, each one an
    ``ImpactIndex`` that is built once and stored; afterwards vectors never move. Queries go to the blocks in passes of
    at most QUERY_BYTES, with a first bar each: the k-th best score among FIRST_ROWS vectors. A task raises the bars as
    it goes from block to block and hands over the best of all its blocks, so later blocks stop early or are skipped.
    Ties go to the smaller id; repeated rows are candidates each, and so are repeated queries; fewer candidates give
    fewer ranks; empty tables give none. Components are exact while sums of products fit a long.
    """
    use = lambda df: df.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(vector)).alias("v")).where("id is not null and v is not null and size(v) > 0")
    spark = rows.sparkSession
    index = _indexed(use(rows))
    asked = stored(use(queries).withColumn("dims", F.size("v")).withColumn("nth", F.monotonically_increasing_id()))
    results = None
    for dims, count in sorted((r.dims, r.n) for r in asked.groupBy("dims").agg(F.count("*").alias("n")).collect()):
        passes = math.ceil(count * dims * 8 / QUERY_BYTES)
        blocks = index.where(F.col("dims") == dims)
        head = blocks.limit(1).collect()  # one block
        first = None
        if head:
            of = ImpactIndex.unpacked(head[0].ids, head[0].vectors, head[0].postings)
            first = of.ids[:FIRST_ROWS], of.vectors[:FIRST_ROWS]
        for turn in range(passes):
            sent = asked.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("nth"), F.lit(passes)) == turn)).select("id", "v").toPandas()  # about QUERY_BYTES
            if not len(sent):
                continue
            held = _Asked(sent["id"].to_numpy(np.int64), np.array(sent["v"].tolist(), np.int64), first, k)
            found = _search(blocks, spark.sparkContext.broadcast(held), k)
            found = stored(found) if passes > 1 else found
            results = found if results is None else results.unionByName(found)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        results.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _search(blocks: DataFrame, sent, k: int) -> DataFrame:
    """Each task's best (query_id, vec_id, score) over all its blocks."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = sent.value
        bars, best = asked.bars.copy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked.ids)
        for batch in batches:
            for r in batch.itertuples(index=False):
                index = ImpactIndex.unpacked(r.ids, r.vectors, r.postings)
                for i in range(0, len(asked.ids), TOGETHER):
                    found = index.search(asked.vectors[i : i + TOGETHER], asked.ids[i : i + TOGETHER], k, bars[i : i + TOGETHER])
                    for j, (ids, scores) in enumerate(found, i):
                        if len(ids):
                            ids, scores = np.concatenate([best[j][0], ids]), np.concatenate([best[j][1], scores])
                            top = np.lexsort((ids, -scores))[:k]
                            best[j] = ids[top], scores[top]
                            if len(top) == k:
                                bars[j] = max(bars[j], scores[top[-1]])
        for i in range(0, len(asked.ids), 4096):
            part = best[i : i + 4096]
            sizes = [len(ids) for ids, _ in part]
            yield pd.DataFrame({"query_id": np.repeat(asked.ids[i : i + 4096], sizes), "vec_id": np.concatenate([x for x, _ in part]), "score": np.concatenate([x for _, x in part])})

    return blocks.select("ids", "vectors", "postings").mapInPandas(search, "query_id long, vec_id long, score long")
