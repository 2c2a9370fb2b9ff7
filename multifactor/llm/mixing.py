"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from multifactor.llm.common import WORD, quoted, row_hash, stored

#: The fractional part of the golden ratio; multiples of it fill the unit interval evenly at every length.
GOLDEN = 0.6180339887498949
#: Words in a block at most, and slots of a schedule at least (of one word each where there are fewer words).
BLOCK_WORDS, LEAST_SLOTS = 4096, 1 << 17
#: Parts of a slot in which sources' needs are counted.
UNITS = 1 << 20
#: Rows that one running sum over ordered rows holds together.
LOT = 4096


@dataclass(frozen=True)
class Mix:
    """A mix: tables of sources, of scheduled slots, and of what each document gives."""

    sources: DataFrame  # source, source_size, weight, target, blocks, slots (that fell to it), words (that the mix takes)
    slots: DataFrame  # position, source, turn (rank in the source), block
    documents: DataFrame  # row (struct of the input's columns but the text), h (row_hash of the row), size, source_size, target, taken


def _numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``nth``, the rank of its ``source`` by code points, null last, from 0; dealt by range, so no task holds all."""
    key = F.struct(F.col("source").isNull(), F.col("source"))
    dealt = stored(sizes.repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    parts = dealt.groupBy("part").agg(F.count("*").alias("m")).select("part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("past"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(key)) - 1
    return dealt.withColumn("inner", inside).join(F.broadcast(parts), "part").select(*sizes.columns, (F.col("past") + F.col("inner")).alias("nth"))


def source_targets(sizes: DataFrame, share: float, weights: list[float], most: float) -> DataFrame:
    """Each source's target words: ``share`` of all words by weight, none above ``most`` times its size.

    ``sizes``: source, source_size. The excess over a full source goes to the others by weight, until none is above: the
    level ``x`` at which the targets min(full, x * weight) add up to the share. Their sum is concave in ``x``, so
    Newton's steps from below, each one aggregation over the table, end at the level after a few.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = stored(_numbered(sizes).withColumn("weight", weight).withColumn("full", F.lit(float(most)) * F.col("source_size")))
    all_words, all_weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    wanted, level = share * all_words, share * all_words / all_weight if all_weight else 0.0
    while True:
        is_full = F.col("full") <= F.lit(level) * F.col("weight")
        full, open_weight = ranked.agg(F.coalesce(F.sum(F.when(is_full, F.col("full"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0))).first()
        following = (wanted - full) / open_weight if open_weight else level
        if following <= level:
            break
        level = following
    return ranked.select("source", "source_size", "weight", "nth", F.least(F.col("full"), F.lit(level) * F.col("weight")).alias("target"))


def mix_sources(
    docs: DataFrame, *, source: str = "source", text: str = "text", share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1),
    most: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 42, bucket_rows: int = 2048, step: float = GOLDEN,
) -> Mix:
    """Mix the sources of ``docs`` so that their words near the targets of ``source_targets``.

    Each source's documents are put in a seeded random order and read as one stream of words, cut into blocks of equal
    words: about ``block_words``, or fewer where the schedule would have under LEAST_SLOTS slots. A source needs as many
    slots as its target has blocks. Slot ``n`` of the schedule takes the point frac((n + 1/2) * ``step``) on the
    cumulated shares of needed slots and so falls to a source; the first slots of the schedule, as many as all sources
    need, are the mix. Slots are ranked inside their source, and the r-th takes the source's r-th block, starting again
    when the stream ends; a slot that comes when its source has given every block ``most`` times stays empty. A document
    gives the words of its blocks as often as slots take them, so never over ``ceil(most)`` times its size.

    What a source gives differs from its target by the points' discrepancy, a few blocks at any length of the schedule:
    ``sources`` holds both figures.

    Orders and running sums go through cells of about ``bucket_rows`` rows or LOT sources, never through a whole source.
    A null source is a source of its own, ordered last; null, empty and blank texts have no words and give none; repeated
    rows count each; an empty table gives empty tables. Reruns over the same rows agree.
    """
    rows = docs.select(
        F.struct(*[F.col(quoted(c)) for c in docs.columns if c != text]).alias("row"), F.col(quoted(source)).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(quoted(text)), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), row_hash(docs, seed).alias("h"),
    )
    rows = stored(rows)
    n_rows, all_words = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    words = min(block_words, max(1, math.ceil(share * all_words / LEAST_SLOTS)))
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, list(weights), most)
    sources = stored(
        sources.withColumn("blocks", F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.round(F.col("source_size") / words))).otherwise(0).cast("long"))
        .withColumn("needed", F.when(F.col("blocks") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    )
    slots = stored(_schedule(sources, step).where(F.col("turn") < F.floor(F.lit(float(most)) * F.col("blocks"))).select("position", "source", "turn", "block"))

    # where each document begins in its source's stream: sums over cells, then inside the cell
    cells = max(1, math.ceil(n_rows / bucket_rows))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(cells))).withColumn("source_key", _null_safe("source"))
    earlier = W.partitionBy("source_key").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("source_key", "cell").agg(F.sum("size").alias("words"))
        .select("source_key", "cell", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    )
    inside = W.partitionBy("source_key", "cell").orderBy("h").rowsBetween(W.unboundedPreceding, -1)
    facts = sources.select(_null_safe("source").alias("source_key"), "source_size", "target", "blocks")
    if sources.count() <= 100_000:  # otherwise Spark joins by key and splits what is skewed
        facts = F.broadcast(facts)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["source_key", "cell"]).join(facts, "source_key")
    placed = placed.select("row", "source_key", "size", "source_size", "target", "blocks", "h", (F.col("offset") + F.col("inner")).alias("begin"))
    placed = stored(placed.withColumn("nth", F.monotonically_increasing_id()))

    # the parts of each document by block, joined to the slots that take the block
    uses = slots.withColumn("source_key", _null_safe("source")).groupBy("source_key", "block").agg(F.count("*").alias("uses"))
    parts = placed.where("size > 0").select(
        "nth", "source_key", "source_size", "blocks", "begin", (F.col("begin") + F.col("size")).alias("stop"),
        F.explode(F.sequence(_block_at(F.col("begin")), _block_at(F.col("begin") + F.col("size") - 1))).alias("block"),
    )
    overlap = F.least(F.col("stop"), _block_start(F.col("block") + 1)) - F.greatest(F.col("begin"), _block_start(F.col("block")))
    given = parts.join(uses, ["source_key", "block"]).groupBy("nth").agg(F.sum(overlap * F.col("uses")).alias("taken"))
    documents = placed.join(given, "nth", "left").select("row", "h", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    turns = slots.withColumn("source_key", _null_safe("source")).groupBy("source_key").agg(F.count("*").alias("slots"))
    met = sources.withColumn("source_key", _null_safe("source")).join(turns, "source_key", "left").withColumn("slots", F.coalesce("slots", F.lit(0)))
    whole = F.expr("slots div greatest(blocks, 1)")
    taken = whole * F.col("source_size") + _block_start(F.col("slots") - whole * F.col("blocks"))
    return Mix(met.select("source", "source_size", "weight", "target", "blocks", "slots", taken.alias("words")), slots, documents)


def _null_safe(name: str):
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("-"))


def _block_start(block: Column) -> Column:
    """The first word of a block: of a stream's ``blocks`` blocks, the first ones are a word longer where the words do not divide."""
    return block * F.expr("source_size div greatest(blocks, 1)") + F.least(block, F.expr("source_size % greatest(blocks, 1)"))


def _block_at(word: Column) -> Column:
    """The block in which a word of the stream lies."""
    base, longer = F.expr("source_size div greatest(blocks, 1)"), F.expr("source_size % greatest(blocks, 1)")
    in_longer = longer * (base + 1)
    return F.when(word < in_longer, F.floor(word / (base + 1))).otherwise(longer + F.floor((word - in_longer) / F.greatest(base, F.lit(1)))).cast("long")


def _schedule(sources: DataFrame, step: float, chunk: int = 1024) -> DataFrame:
    """Slots (position, source, blocks, turn, block) for sources with ``nth``, ``blocks`` and ``needed``."""
    spark = sources.sparkSession
    # needs in whole units, so that sums are exact and neighbouring shares meet in one number
    units = F.round(F.col("needed") * UNITS).cast("long")
    all_units, n_sources = sources.agg(F.coalesce(F.sum(units), F.lit(0)), F.count("*")).first()
    lots = sources.withColumn("units", units).withColumn("lot", F.floor(F.col("nth") / LOT))
    earlier = W.orderBy("lot").rowsBetween(W.unboundedPreceding, -1)  # one row for each lot
    past = lots.groupBy("lot").agg(F.sum("units").alias("all")).select("lot", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("past"))
    so_far = F.sum("units").over(W.partitionBy("lot").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow))
    bounds = lots.withColumn("so_far", so_far).join(past, "lot").where("units > 0").withColumn("so_far", F.col("past") + F.col("so_far"))
    share = lambda c: c.cast("double") / float(max(all_units, 1))
    bounds = bounds.select("nth", "source", "blocks", share(F.col("so_far") - F.col("units")).alias("low"), share(F.col("so_far")).alias("upto"))
    # points meet the shares in small cells of the unit interval, so no point is held against all sources
    cells = max(16, 4 * n_sources)
    bounds = bounds.select("*", F.explode(F.sequence(F.floor(F.col("low") * cells).cast("long"), F.least(F.floor(F.col("upto") * cells), F.lit(cells - 1)).cast("long"))).alias("cell"))
    points = spark.range(round(all_units / UNITS)).select(F.col("id").alias("position"), ((F.col("id") + 0.5) * F.lit(step) % 1.0).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells).cast("long"))
    fallen = points.join(bounds, "cell").where("u >= low and u < upto").select("position", "nth", "source", "blocks", F.floor(F.col("position") / chunk).alias("chunk"))
    # ranks in a source: slots in earlier chunks, then the place in the chunk
    earlier = W.partitionBy("nth").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = fallen.groupBy("nth", "chunk").agg(F.count("*").alias("m")).select("nth", "chunk", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("past"))
    turn = F.col("past") + F.row_number().over(W.partitionBy("nth", "chunk").orderBy("position")) - 1
    ranked = fallen.join(counts, ["nth", "chunk"]).select("position", "source", "blocks", turn.alias("turn"))
    return ranked.withColumn("block", F.col("turn") % F.col("blocks"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: a row comes once for each time it is taken, to the nearest whole.

    Only documents that a cut between blocks parts are rounded. Columns are those of ``docs``; equal rows count together.
    Null, empty and blank texts have no words and are never taken; an empty table gives none.
    """
    seed = options.get("seed", 42)
    copies = mix_sources(docs, **options).documents.select("h", F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int").alias("copies"))
    copies = stored(copies.groupBy("h").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")))
    records = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("record"), row_hash(docs, seed).alias("h"))
    if copies.where("rows > 1").limit(1).count():  # equal rows: one stands for all, with the copies of all
        records = records.dropDuplicates(["h"])
    taken = records.join(copies.where("copies > 0"), "h")
    return taken.select("record", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("record.*")
