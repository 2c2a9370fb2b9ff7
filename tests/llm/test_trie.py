"""The conversation trie against a brute-force version."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from multifactor.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, part string, n long, `a.b` string"


def brute(rows):
    """Nodes (conv, depth, parent, n, children, leaves, saved, ends) of the rebuilt conversations."""
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in said.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(head, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, who in members.items():
        below = [m for m in members if m[: len(node)] == node]
        childless = lambda m: not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)
        ends = ",".join(str(c) for c in sorted(who) if built[c] == node)
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(x) == len(node) + 1 for x in below), sum(map(childless, below)),
            sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def nodes(spark, rows, shard_turns):
    table = spark.createDataFrame([(*r, "p", 1, "x") for r in rows], SCHEMA).repartition(3)
    found = trie.conversation_trie(table, shard_turns=shard_turns)
    return sorted([tuple(r) for r in found.select("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256").collect()], key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for c in [*range(0, 8), 100, 101, 102, 205, 206, 300, 301, -5, -100, -101]:
        for t in range(rng.randrange(1, 7)):
            out.append((c, rng.choice([t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["é漢字", "", None, "hi"])))
    out += [(c, t, "user", f"turn {t}") for c in (310, 311, 312, 415) for t in range(9 if c < 415 else 2)]  # copies
    out += [(500, t, "user", "long" * (t % 3)) for t in range(60)] + [(501, t, "user", "long" * (t % 3)) for t in range(57)]
    out += [(7, 1, "user", "again"), (7, 1, "user", "again"), (None, 0, "user", "nobody's"), (800, None, None, None), (801, 0, "user", "x" * 100_000)]
    return out


@pytest.mark.parametrize("shard_turns", [4, 25, 16_384])
def test_nodes_equal_brute_force_at_every_shard_size(spark, rows, shard_turns):
    assert nodes(spark, rows, shard_turns) == brute(rows)


def test_hot_heads_and_many_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "ENDS_PIECE", 3)
    rows = [(c, t, "system", "you help") for c in range(40) for t in range(2)] + [(c, 2, "user", str(c)) for c in range(0, 40, 3)]
    assert nodes(spark, rows, 16) == brute(rows)


def test_empty_table_has_no_node(spark):
    assert nodes(spark, [], 16) == [] and nodes(spark, [(None, 1, "user", "x")], 16) == []


def test_other_column_names(spark):
    table = spark.createDataFrame([(1, 2, "b", "y"), (1, 1, "a", "x")], "`c.id` long, at long, who string, `said``` string")
    found = trie.conversation_trie(table, conv="c.id", turn="at", role="who", text="said`")
    assert found.count() == 1 + max(0, 2 - zlib.crc32(b"1") % 6) and found.where(F.col("depth") == 0).first()["n_convs"] == 1
