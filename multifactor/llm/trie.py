"""A prefix trie of conversations by vertical bitmaps: shards of conversations, merged by the nodes' keys."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from multifactor.llm.common import quoted, stored

#: Turns (and roots) of a shard, about; a conversation with more turns is cut into shards of its own.
SHARD_TURNS = 16_384
#: Conversation ids in one piece of a node's list of ends.
ENDS_PIECE = 512
_NODE = "pre int, last int, a long, b long, pa long, pb long, depth int, conv long, n long, size long, first_end long, ends array<string>"


def ordered_turns(
    conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv, part, pos from 0, mark, size), and how many each conversation has in each part as (conv, part, m).

    Turns are in the order of ``turn``, null first; equal ones by role, then by the MD5 of the text. ``mark`` is the MD5 of
    role and text (null: empty), which stands for the texts from here on; ``size`` is the text's code points. Rows without a
    conversation are left out. Turns are dealt by range, so a conversation of any length spreads over tasks.
    """
    said, by = F.coalesce(F.col(quoted(text)), F.lit("")), F.coalesce(F.col(quoted(role)), F.lit(""))
    mark = F.md5(F.concat(F.char_length(by).cast("string"), F.lit(":"), by, said).cast("binary"))
    slim = conversations.where(F.col(quoted(conv)).isNotNull()).select(
        F.col(quoted(conv)).cast("long").alias("conv"), F.col(quoted(turn)).alias("turn"), by.alias("role"), F.md5(said.cast("binary")).alias("said"),
        mark.alias("mark"), F.char_length(said).cast("long").alias("size"),
    )
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("said")]
    dealt = stored(slim.repartitionByRange(F.col("conv"), *order).withColumn("part", F.spark_partition_id()))
    held = stored(dealt.groupBy("conv", "part").agg(F.count("*").alias("m")))
    earlier = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # a part's first conversation alone can have begun before it: a row for each part at most
    begun = F.broadcast(held.withColumn("past", F.sum("m").over(earlier)).where("past > 0").select("conv", "part", "past"))
    inside = F.row_number().over(W.partitionBy("part", "conv").orderBy(*order)) - 1
    turns = dealt.withColumn("inner", inside).join(begun, ["conv", "part"], "left")
    return turns.select("conv", "part", (F.coalesce("past", F.lit(0)) + F.col("inner")).cast("int").alias("pos"), "mark", "size"), held


def _hashes() -> list[Column]:
    """128 bits of a turn at its depth; the exclusive-or of those of a prefix's turns is the prefix's key."""
    return [F.xxhash64(F.lit(seed), F.col("depth"), F.col("mark")).alias(name) for seed, name in ((71, "a"), (72, "b"))]


def shared_heads(turns: DataFrame, held: DataFrame, *, block: int = 100, most: int = 5, shard_turns: int = SHARD_TURNS) -> tuple[DataFrame, DataFrame]:
    """Conversations that take their first turns from the first of their block: (conv, n_turns, part, sub), and their turns.

    With h = crc32 of the decimal id modulo ``most`` + 1, conversation c has the first h turns of conversation
    c - c % ``block`` (all, if it has fewer, and none, if there is none), then its own after its first h.
    ``sub`` numbers shards of about ``shard_turns`` turns inside a part; conversations with more turns have none.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    convs = held.groupBy("conv").agg(F.sum("m").alias("m"), F.min("part").alias("part"))
    convs = convs.withColumn("h", h).withColumn("block", F.col("conv") - F.col("conv") % block)
    first = convs.where(F.col("conv") % block == 0).select(F.col("conv").alias("block"), F.col("m").alias("block_m"))
    convs = convs.join(first, "block", "left").withColumn("k", F.least("h", F.coalesce("block_m", F.lit(0))))
    convs = convs.withColumn("n_turns", F.col("k") + F.greatest(F.col("m") - F.col("h"), F.lit(0)))
    before = F.coalesce(F.sum(F.when(F.col("n_turns") <= shard_turns, F.col("n_turns") + 1)).over(W.partitionBy("part").orderBy("conv").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sub = F.when(F.col("n_turns") <= shard_turns, F.floor(before / shard_turns))
    convs = stored(convs.select("conv", "block", "h", "k", "n_turns", "part", sub.cast("long").alias("sub")))
    # a conversation's facts meet its turns by part, so that no key has more rows than a part
    facts = held.select("conv", "part").join(convs.withColumnRenamed("part", "home"), "conv")
    own = turns.join(facts, ["conv", "part"]).where("pos >= h").select("conv", "home", "sub", "n_turns", (F.col("pos") - F.col("h") + F.col("k") + 1).cast("int").alias("depth"), "mark", "size")
    heads = turns.where((F.col("conv") % block == 0) & (F.col("pos") < most)).select(F.col("conv").alias("block"), "pos", "mark", "size")
    lent = convs.where("k > 0").join(heads, "block").where("pos < k").select("conv", F.col("part").alias("home"), "sub", "n_turns", (F.col("pos") + 1).cast("int").alias("depth"), "mark", "size")
    return convs, own.unionByName(lent).select("conv", F.col("home").alias("part"), "sub", "n_turns", "depth", *_hashes(), "size")


def shard_trie(rows: pd.DataFrame) -> pd.DataFrame:
    """The trie of one shard's conversations, its nodes in the order of a depth-first walk.

    ``rows`` has a turn (conv, depth, a, b, size) or, with depth 0, a conversation in each row. Each (depth, turn) has a
    posting: the bitmap of the conversations that have this turn there, by their rank. A node's bitmap without those that
    end there is intersected with the posting of its lowest conversation's next turn; that is a child, and what remains
    gives the others. A bit count gives a node's conversations, the lowest bit the smallest of them.
    """
    ids = np.unique(rows["conv"].to_numpy())
    rows = rows[rows["depth"] > 0]
    who = np.searchsorted(ids, rows["conv"].to_numpy())
    order = np.lexsort((rows["depth"].to_numpy(), who))
    who, depth, size = who[order], rows["depth"].to_numpy()[order], rows["size"].to_numpy()[order].tolist()
    a, b = rows["a"].to_numpy()[order], rows["b"].to_numpy()[order]
    begin = np.searchsorted(who, np.arange(len(ids) + 1)).tolist()  # a conversation's turns are begin[i] + depth - 1
    if len(who):
        term = pd.DataFrame({"depth": depth, "a": a, "b": b}).groupby(["depth", "a", "b"], sort=False).ngroup().to_numpy()
        by_term = np.argsort(term, kind="stable")
        edges = np.searchsorted(term[by_term], np.arange(term.max() + 2)).tolist()
        holders = who[by_term].tolist()
        term = term.tolist()
    postings: dict[int, int] = {}

    def posting(t: int) -> int:
        if t not in postings:
            bits = 0
            for i in holders[edges[t] : edges[t + 1]]:
                bits |= 1 << i
            postings[t] = bits
        return postings[t]

    a, b, convs = a.tolist(), b.tolist(), ids.tolist()
    length = np.diff(begin)
    ending: dict[int, int] = {}
    for i, n in enumerate(length.tolist()):
        ending[n] = ending.get(n, 0) | 1 << i
    out, parents = [], []
    stack = [((1 << len(ids)) - 1, 0, 0, 0, -1, 0)]
    while stack:
        bits, d, ka, kb, up, size_here = stack.pop()
        low = (bits & -bits).bit_length() - 1
        at = begin[low] + d - 1
        ends = bits & ending.get(d, 0)
        ended = []
        rest = ends
        while rest:
            i = (rest & -rest).bit_length() - 1
            ended.append(convs[i])
            rest &= rest - 1
        pa_, pb_ = (ka ^ a[at], kb ^ b[at]) if d else (None, None)
        pieces = [",".join(map(str, ended[i : i + ENDS_PIECE])) for i in range(0, len(ended), ENDS_PIECE)]
        me = len(out)
        out.append((ka, kb, pa_, pb_, d, convs[low], bits.bit_count(), size_here, ended[0] if ended else None, pieces))
        parents.append(up)
        rest, found = bits ^ ends, []
        while rest:
            at = begin[(rest & -rest).bit_length() - 1] + d
            child = rest & posting(term[at])
            found.append((child, d + 1, ka ^ a[at], kb ^ b[at], me, size[at]))
            rest ^= child
        stack.extend(reversed(found))
    last = list(range(len(out)))
    for i in range(len(out) - 1, 0, -1):
        last[parents[i]] = max(last[parents[i]], last[i])
    names = ("a", "b", "pa", "pb", "depth", "conv", "n", "size", "first_end", "ends")
    columns = {name: [r[i] for r in out] for i, name in enumerate(names)}
    optional = {c: pd.array(columns[c], "Int64") for c in ("pa", "pb", "first_end")}
    return pd.DataFrame({"pre": range(len(out)), "last": last, **columns, **optional})


def _shard_nodes(convs: DataFrame, turns: DataFrame, shard_turns: int) -> DataFrame:
    """Nodes of all shards: shard (one, two), and the columns of _NODE."""
    zero = [F.lit(0).cast("int").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "size")]]
    marks = convs.select("conv", "part", "sub", "n_turns", *zero)
    every = turns.unionByName(marks)

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = shard_trie(rows)
        found.insert(0, "two", key[1])
        found.insert(0, "one", key[0])
        return found

    small = every.where("sub is not null").select("part", "sub", "conv", "depth", "a", "b", "size")
    small = small.groupBy("part", "sub").applyInPandas(build, f"one long, two long, {_NODE}")
    # a long conversation is a chain: its keys are running exclusive-ors, inside pieces and over their totals
    piece = F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / shard_turns).cast("long")
    long = every.where("sub is null").withColumn("piece", piece)
    totals = long.groupBy("conv", "piece").agg(F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"))
    earlier = W.partitionBy("conv").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    past = totals.select("conv", "piece", *[F.coalesce(F.bit_xor(t).over(earlier), F.lit(0).cast("long")).alias(t) for t in ("ta", "tb")])
    so_far = W.partitionBy("conv", "piece").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    long = long.withColumn("ia", F.bit_xor("a").over(so_far)).withColumn("ib", F.bit_xor("b").over(so_far)).join(past, ["conv", "piece"])
    key_a, key_b, ends = F.col("ta").bitwiseXOR(F.col("ia")), F.col("tb").bitwiseXOR(F.col("ib")), F.col("depth") == F.col("n_turns")
    long = long.select(
        F.col("conv").alias("one"), (-1 - F.col("piece")).alias("two"), F.col("depth").alias("pre"), F.least(F.col("n_turns"), (F.col("piece") + 1) * shard_turns).cast("int").alias("last"),
        key_a.alias("a"), key_b.alias("b"), F.when(F.col("depth") > 0, key_a.bitwiseXOR(F.col("a"))).alias("pa"), F.when(F.col("depth") > 0, key_b.bitwiseXOR(F.col("b"))).alias("pb"),
        "depth", "conv", F.lit(1).cast("long").alias("n"), "size", F.when(ends, F.col("conv")).alias("first_end"),
        F.when(ends, F.array(F.col("conv").cast("string"))).otherwise(F.expr("cast(array() as array<string>)")).alias("ends"),
    )
    return stored(small.unionByName(long))


def _below(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """(a, b, saved, leaves) of nodes with several conversations, summed over their subtrees.

    A node's (n - 1) * size is the sum over shards of (n there) * size, less size in the shard of its smallest conversation; a
    childless node counts there too. So each shard sums its own subtrees, which are ranges of its walk, and sums add up.
    """
    facts = merged.where("n > 1 or n_children = 0").select("a", "b", F.col("conv").alias("owner"), F.col("n").alias("all_n"), "n_children")
    owns = (F.col("conv") == F.col("owner")).cast("long")
    rows = nodes.join(facts, ["a", "b"]).select(
        "one", "two", "pre", "last", "a", "b", "all_n", ((F.col("n") - owns) * F.col("size")).alias("saved"), F.when(F.col("n_children") == 0, owns).otherwise(0).cast("long").alias("leaves")
    )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pre", kind="stable").reset_index(drop=True)
        upto = np.searchsorted(rows["pre"].to_numpy(), rows["last"].to_numpy(), side="right")
        out = rows[["one", "two", "a", "b", "all_n"]].copy()
        for c in ("saved", "leaves"):
            total = np.concatenate([[0], np.cumsum(rows[c].to_numpy(), dtype=np.int64)])
            out[c] = total[upto] - total[:-1]
        return out

    sums = rows.groupBy("one", "two").applyInPandas(add, "one long, two long, a long, b long, all_n long, saved long, leaves long").where("all_n > 1")
    # pieces of a long conversation (two < 0) go on in its later pieces
    later = W.partitionBy("one").orderBy(F.desc("two")).rowsBetween(1, W.unboundedFollowing)
    totals = rows.where("two < 0").groupBy("one", "two").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    carried = totals.select("one", "two", F.coalesce(F.sum("s").over(later), F.lit(0)).alias("s"), F.coalesce(F.sum("l").over(later), F.lit(0)).alias("l"))
    long = sums.where("two < 0").join(carried, ["one", "two"]).select("a", "b", (F.col("saved") + F.col("s")).alias("saved"), (F.col("leaves") + F.col("l")).alias("leaves"))
    return sums.where("two >= 0").select("a", "b", "saved", "leaves").unionByName(long).groupBy("a", "b").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of equal (a, b), its pieces joined by commas; only the running hash is held."""
    key, running = None, None
    for batch in batches:
        done: list[tuple] = []
        for a, b, piece in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if key == (a, b):
                running.update(b",")
            else:
                if key is not None:
                    done.append((*key, running.hexdigest()))
                key, running = (a, b), hashlib.sha256()
            running.update(piece.encode())
        yield pa.RecordBatch.from_pydict({"a": pa.array([d[0] for d in done], pa.int64()), "b": pa.array([d[1] for d in done], pa.int64()), "sha": pa.array([d[2] for d in done], pa.string())})
    if key is not None:
        yield pa.RecordBatch.from_pydict({"a": [key[0]], "b": [key[1]], "sha": [running.hexdigest()]})


def prefix_trie(convs: DataFrame, turns: DataFrame, *, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Every distinct prefix of the conversations as a node, from the root, which has no turn.

    ``convs`` and ``turns`` are those of shared_heads. A node has its key (a, b), conv (its smallest conversation),
    depth, parent_conv, n_convs, n_children, n_leaves (childless nodes in its subtree, itself included), saved (the sum
    over its subtree of (n_convs - 1) times the code points of a node's last text) and ends_sha256 (of the ids of the
    conversations that end there, in order, joined by commas). A node's last turn is turn ``depth`` of ``conv``.

    Shards are ranges of conversations with a bounded number of turns; each builds its trie by bitmaps (shard_trie), and
    nodes with equal keys of 128 bits are one. What needs all shards (smallest conversation, children) is known after that;
    subtree sums are then taken in the shards and added up. Lists of ends meet in pieces and are hashed as a stream.
    Repeated turns are turns; an empty table has no node.
    """
    nodes = _shard_nodes(convs, turns, shard_turns)
    merged = nodes.groupBy("a", "b").agg(F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max("size").alias("size"))
    merged = stored(merged)
    children = merged.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    merged = stored(merged.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    shared = merged.where("n > 1").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv"))
    root = merged.where("depth = 0").select("conv").first()
    deep = merged.where("depth > 1").join(shared, ["pa", "pb"], "left")  # a parent with one conversation has its child's
    deep = deep.withColumn("parent_conv", F.coalesce("parent_conv", "conv"))
    top = merged.where("depth <= 1").withColumn("parent_conv", F.when(F.col("depth") == 1, F.lit(root["conv"] if root else None)).cast("long"))
    named = deep.unionByName(top)
    sums = _below(nodes, merged)
    alone = named.where("n = 1").withColumn("saved", F.lit(0).cast("long")).withColumn("leaves", F.lit(1).cast("long"))
    whole = named.where("n > 1").join(sums, ["a", "b"]).unionByName(alone)
    pieces = nodes.where("first_end is not null").select("a", "b", "first_end", F.posexplode("ends").alias("i", "piece"))
    digests = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first_end", "i").select("a", "b", "piece").mapInArrow(_digests, "a long, b long, sha string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.join(digests, ["a", "b"], "left").select(
        "a", "b", "conv", "depth", "parent_conv", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), "saved", F.coalesce("sha", none).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, *, shard_turns: int = SHARD_TURNS, **columns: str) -> DataFrame:
    """The prefix trie of a table of turns (columns named by ``conv``, ``turn``, ``role``, ``text``) with shared heads."""
    return prefix_trie(*shared_heads(*ordered_turns(conversations, **columns), shard_turns=shard_turns), shard_turns=shard_turns)
