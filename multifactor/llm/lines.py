"""Line deduplication: suffix ranks of line-ID sequences by distributed prefix doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from multifactor.llm.common import WORD, quoted, row_hash, stored

#: A repeated run of lines is deleted if it holds so many words.
MIN_WORDS = 50


def _ranks(pairs: DataFrame, partitions: int) -> DataFrame:
    """``pairs`` (first, second, n) with ``rank``: 1 and the number of suffixes with a smaller pair.

    Pairs are dealt out by range and stored with their part; sums inside parts and over the few parts give the rank, so
    no window holds all pairs, nor all pairs of one line.
    """
    dealt = stored(pairs.repartitionByRange(partitions, "first", "second").withColumn("part", F.spark_partition_id()))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.sum("n").alias("m")).select("part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("past"))
    inside = W.partitionBy("part").orderBy("first", "second").rowsBetween(W.unboundedPreceding, -1)
    summed = dealt.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return stored(summed.join(F.broadcast(parts), "part").select("first", "second", (F.col("past") + F.col("inner") + 1).alias("rank")))


def repeated_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Stored documents (``nth``, ``key``, ``h``, ``lines``) and the lines to delete (``nth``, ``line``).

    Lines end at newlines; lines without words are passed over, neither deleted nor breaking a run. A line is deleted if
    it lies in a run of consecutive lines of at least ``min_words`` words that also stands earlier: in a document with a
    smaller key (null keys last), or earlier in the same one. So the first copy of every run stays.

    Suffixes of each document's line-ID sequence are ranked by prefix doubling: at level k a suffix's rank counts the
    suffixes whose first 2^k lines come before its own, and the pair of ranks at distance 2^k gives the next level. Two
    suffixes share an interval of common prefix m if their ranks agree at the level below m at both ends of the first m
    lines. As a run needs at most ``min_words`` lines to hold so many words, levels end there, whatever the input.
    Unions of the shortest such runs that start or end at a line are the maximal repeated runs.

    Null and empty texts have no lines; repeated rows are documents of their own; an empty table gives empty tables.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = docs.select(
        F.monotonically_increasing_id().alias("nth"), F.col(quoted(key)).alias("key"), row_hash(docs, 42).alias("h"),
        F.split(F.coalesce(F.col(quoted(text)), F.lit("")), "\n").alias("lines"),
    )
    held = stored(raw.select("nth", "key", "h", F.transform("lines", lambda x: F.struct(F.unhex(F.md5(x)).alias("id"), F.regexp_count(x, F.lit(WORD)).alias("words"))).alias("lines")))
    lines = held.select("nth", "key", F.posexplode(F.expr("filter(transform(lines, (x, i) -> named_struct('id', x.id, 'words', x.words, 'line', i)), x -> x.words > 0)")).alias("i", "x"))
    lines = lines.select("nth", "key", "i", "x.line", "x.words", "x.id")

    # only lines that stand more than once, in unbroken stretches with enough words, can be in a repeated run
    ids = stored(lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"))
    ids = _ranks(ids.select(F.col("id").alias("first"), F.lit(0).cast("long").alias("second"), "n"), partitions).select(F.col("first").alias("id"), "rank")
    in_doc = W.partitionBy("nth").orderBy("i")
    known = lines.join(ids, "id").withColumn("stretch", F.col("i") - F.row_number().over(in_doc))
    in_stretch = W.partitionBy("nth", "stretch")
    known = known.withColumn("all_words", F.sum("words").over(in_stretch)).where(F.col("all_words") >= min_words)
    known = known.withColumn("end", F.sum("words").over(in_stretch.orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    state = stored(known.select("nth", "key", "stretch", "i", "line", "words", "end", F.col("rank").alias("r0")))

    levels = 1
    while 2**levels <= min_words:
        r, ahead = f"r{levels - 1}", 2 ** (levels - 1)
        there = F.first(r).over(in_doc.rangeBetween(ahead, ahead))
        step = state.withColumn("second", there)
        pairs = step.where(f"{r} is not null and second is not null").groupBy(F.col(r).alias("first"), "second").agg(F.count("*").alias("n")).where("n > 1")
        pairs = stored(pairs)
        if not pairs.limit(1).count():
            break
        ranked = _ranks(pairs, partitions).withColumnRenamed("rank", f"r{levels}")
        step = stored(step)
        state = stored(step.join(ranked, (step[r] == ranked["first"]) & (step["second"] == ranked["second"]), "left").select(*state.columns, f"r{levels}"))
        levels += 1

    # the shortest runs with enough words from each line on, and up to each line
    begin = F.col("end") - F.col("words")
    marks = state.select("nth", "stretch", "i", F.col("end").alias("at"), F.lit(1).alias("kind")).unionByName(
        state.select("nth", "stretch", "i", (begin + min_words).alias("at"), F.lit(0).alias("kind")))
    onward = W.partitionBy("nth", "stretch").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(W.unboundedPreceding, W.currentRow)
    forward = marks.withColumn("other", F.last(F.when(F.col("kind") == 1, F.col("i")), ignorenulls=True).over(onward)).where("kind = 0 and other is not null")
    marks = state.select("nth", "stretch", "i", begin.alias("at"), F.lit(0).alias("kind")).unionByName(
        state.select("nth", "stretch", "i", (F.col("end") - min_words).alias("at"), F.lit(1).alias("kind")))
    back = W.partitionBy("nth", "stretch").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    backward = marks.withColumn("other", F.last(F.when(F.col("kind") == 0, F.col("i")), ignorenulls=True).over(back)).where("kind = 1 and other is not null")
    runs = forward.select("nth", F.col("i").alias("a"), F.col("other").alias("b")).unionByName(backward.select("nth", F.col("other").alias("a"), F.col("i").alias("b"))).distinct()
    level = sum((F.when(F.col("b") - F.col("a") + 1 >= 2**k, 1).otherwise(0) for k in range(1, min_words.bit_length() + 1)), F.lit(0))
    runs = runs.withColumn("level", level).where(F.col("level") < levels).withColumn("i", F.expr("b + 1 - shiftleft(1, level)"))
    rank_at = F.element_at(F.array(*[F.col(f"r{k}") for k in range(levels)]), F.col("level") + 1)
    tails = runs.join(state.drop("key", "words", "end", "line"), ["nth", "i"]).select("nth", "a", "b", "level", rank_at.alias("tail"))
    heads = tails.join(state.select("nth", "key", F.col("i").alias("a"), *[f"r{k}" for k in range(levels)]), ["nth", "a"])
    classed = heads.select("nth", "key", "a", "b", "level", "tail", rank_at.alias("head"), (F.col("b") - F.col("a")).alias("length")).where("head is not null and tail is not null")
    classed = stored(classed)
    place = F.struct(F.col("key").isNull().alias("nokey"), "key", "nth", "a")
    firsts = stored(classed.groupBy("head", "tail", "length", "level").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = classed.join(firsts, ["head", "tail", "length", "level"]).where((F.col("first.nth") != F.col("nth")) | (F.col("first.a") != F.col("a")))

    # lines under a later copy: runs begun and not yet ended
    turns = later.select("nth", F.col("a").alias("i"), F.lit(1).alias("d")).unionByName(later.select("nth", (F.col("b") + 1).alias("i"), F.lit(-1).alias("d")))
    turns = turns.groupBy("nth", "i").agg(F.sum("d").alias("d")).select("nth", "i", "d", F.lit(None).cast("int").alias("line"))
    both = turns.unionByName(state.select("nth", "i", F.lit(0).cast("long").alias("d"), "line"))
    so_far = W.partitionBy("nth").orderBy("i").rangeBetween(W.unboundedPreceding, W.currentRow)
    deleted = both.withColumn("open", F.sum("d").over(so_far)).where("line is not null and open > 0").select("nth", "line")
    return held.select("nth", "key", "h", F.size("lines").alias("lines")), deleted


def deleted_spans(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: ``nth``, ``key``, ``h``, ``lines``, ``removed`` (count) and ``spans``.

    ``spans`` are the deleted lines in ascending runs, as structs of first and last line (from 0).
    """
    held, deleted = repeated_runs(docs, **options)
    runs = deleted.withColumn("run", F.col("line") - F.row_number().over(W.partitionBy("nth").orderBy("line")))
    runs = runs.groupBy("nth", "run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n"))
    by_doc = runs.groupBy("nth").agg(F.sum("n").alias("removed"), F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
    empty = F.expr("cast(array() as array<struct<first:int,last:int>>)")
    return held.join(by_doc, "nth", "left").withColumn("removed", F.coalesce("removed", F.lit(0))).withColumn("spans", F.coalesce("spans", empty))


def drop_repeated_lines(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from the texts; see ``repeated_runs``.

    Equal rows are one row with the results that its copies have and how many have each; no task holds them all. A null
    text stays null; an empty table gives none.
    """
    results = deleted_spans(docs, text=text, **options).groupBy("h", "spans").agg(F.count("*").alias("copies"))
    results = stored(results)
    records = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("record"), row_hash(docs, 42).alias("h"))
    if results.groupBy("h").agg(F.sum("copies").alias("n")).where("n > 1").limit(1).count():
        records = records.dropDuplicates(["h"])
    cut = F.expr(f"array_join(filter(split(record.{quoted(text)}, '\\n'), (x, i) -> not exists(spans, s -> i between s.first and s.last)), '\\n')")
    met = records.join(results, "h").select("record", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return met.select(*[cut.alias(c) if c == text else F.col(f"record.{quoted(c)}") for c in docs.columns])
