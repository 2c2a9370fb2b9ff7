"""Importance resampling against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from multifactor.llm import resample

SCHEMA = "doc_id long, text string, weight string, part string, h string, `a.b` string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, most):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)], len(words)


def brute(docs, target, most, buckets, percent, least):
    """(doc_id, n_words, n_features, weight, score, rank) of each row, and the number drawn."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in docs for g in grams(t, most)[0])
    t = Counter(bucket(g) for x in target for g in grams(x, most)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, text in docs:
        found, n = grams(text, most)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in found)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[5] = k + 1
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [*"alpha Beta GAMMA delta É漢字 x 0 42 naïve".split(), "w" * 31, "w" * 32, "v" * 33, "u" * 500]
    made = [" ,.\n-"[rng.randrange(5)].join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    docs = [*enumerate([None, "", " .. \n", "İ ı ß", " ".join(rng.choice(words) for _ in range(20_000)), *made]), (7, made[2]), (7, made[2]), (None, made[0]), (None, None)]
    return docs, [None, "", *made[::7], "alpha alpha alpha beta gamma"]


def test_vectorised_hash_equals_the_library():
    rng = np.random.default_rng(1)
    for length in [*range(1, 40), 100]:
        rows = rng.integers(0, 256, (5, length), dtype=np.uint8)
        assert resample.xxhash64(rows).tolist() == [xxhash.xxh64_intdigest(r.tobytes()) for r in rows]


def test_table_verifies_bytes_of_equal_keys(monkeypatch):
    monkeypatch.setattr(resample, "xxhash64", lambda rows: np.full(len(rows), 5, np.uint64))  # every key collides
    data = np.frombuffer(b"aa bb aa cc bb d ", dtype=np.uint8)
    table = resample.NgramTable(data, 6)
    slots = table.intern(np.array([0, 3, 6, 9, 12, 15]), np.array([2, 2, 2, 2, 2, 1]))
    assert slots[0] == slots[2] and slots[1] == slots[4] and len(set(slots.tolist())) == 4
    assert table.count[slots].tolist() == [2, 2, 2, 1, 2, 1]
    table.set_buckets(1000)
    assert table.bucket[slots].tolist() == [zlib.crc32(w) % 1000 for w in (b"aa", b"bb", b"aa", b"cc", b"bb", b"d")]


@pytest.mark.parametrize("most,buckets,percent,least,room", [(1, 10_000, 10, 20, 1 << 20), (3, 50, 60, 1, 64)])
def test_scores_equal_brute_force(spark, monkeypatch, texts, most, buckets, percent, least, room):
    docs, target = texts
    monkeypatch.setattr(resample, "TABLE_ROOM", room)
    table = spark.createDataFrame([(i, t, "w", "p", "h", "ab") for i, t in docs], SCHEMA).repartition(3)
    aimed = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resampling_scores(table, aimed, most=most, buckets=buckets, percent=percent, least_words=least)
    rows = sorted([tuple(r) for r in got.select("key", "n_words", "n_features", "weight", "score", "rank").collect()], key=str)
    assert rows == sorted(map(tuple, brute(docs, target, most, buckets, percent, least)), key=str)
    drawn = resample.resampled(table, aimed, most=most, buckets=buckets, percent=percent, least_words=least)
    assert drawn.columns == table.columns and drawn.count() == sum(r[5] is not None for r in rows)
    assert Counter(drawn.toPandas()["doc_id"].fillna(-1)) == Counter(-1 if r[0] is None else r[0] for r in rows if r[5])


def test_empty_tables(spark, texts):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "alpha " * 30, *"wpha")], SCHEMA)
    assert resample.resampling_scores(none, none).count() == 0 and resample.resampled(none, some).count() == 0
    assert resample.resampling_scores(some, none, percent=100).first()["rank"] == 1
