"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from multifactor.llm import decontamination, language, lines, mixing, pii, quality, sharding, simhash, topk, toxicity
from multifactor.llm.common import hashed_words, held_out

SCHEMA = "doc_id long, text string, lang string, source string, shard string, size string, h string, row string, key string, fp string, nth string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) * (rng.random() < 0.3) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Rows with every trouble: nulls, empties, a very long text, copies, near copies, a repeated row."""
    rng = random.Random(5)
    texts = [None, "", "  \n\t ", ".", "é\x00\x01 ñ 漢字", sentence(rng, 30_000)]
    base = sentence(rng, 120)
    texts += [base, base, base.replace("alpha", "alphb", 1), base + " end"]
    texts += [sentence(rng, rng.randrange(1, 200)) for _ in range(30)]
    out = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "src"][i % 4], "x", "y", "z", "w", "k", "f", "n") for i, t in enumerate(texts)]
    out += [out[12], out[12], (None, "null id", None, None, *["q"] * 7), (None, None, None, None, *[None] * 7)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_hashed_words_finds_words_and_places():
    texts = [b"Aa, bb  aa\xc3\xa9.", b"", b"BB"]
    hashes, first, after, before = hashed_words(texts, (1,))
    assert before.tolist() == [0, 3, 3, 4]
    assert [texts[0][a:b] for a, b in zip(first[:3], after[:3], strict=True)] == [b"Aa", b"bb", b"aa\xc3\xa9"]
    assert hashes[0][1] == hashes[0][3] and hashes[0][0] != hashes[0][2] and hashes[1][0] == hashes[1][2]


# -- 1 sharding


def test_sharding_law_slots_and_reruns(spark, docs, rows):
    run = lambda df, n: [tuple(r) for r in sharding.shard_documents(df, n, bucket_bytes=20_000).select("record.doc_id", "record.text", "record.shard", "size", "shard", "slot", "grown_shard").collect()]
    got = run(docs, 5)
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((r[0], r[1], r[4]) for r in rows)
    by_shard = {}
    for _, text, _, size, shard, slot, grown in got:
        assert size == len((text or "").encode()) + 16 and grown in (shard, 5)
        by_shard.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sorted(got, key=repr) == sorted(run(docs.repartition(7), 5), key=repr)
    grown = {(r[0], r[1]): r[4] for r in run(docs, 6)}
    assert all(grown[r[0], r[1]] == r[6] for r in got)
    part = {r[0]: r[4] for r in run(docs.where("doc_id % 3 = 0"), 5)}
    assert all(r[4] == part[r[0]] for r in got if r[0] is not None and r[0] % 3 == 0)


def test_shards_buckets_and_slots_by_brute_force(spark, docs, rows):
    """The law and the places recomputed: hashes by Spark row by row, everything else here."""
    data = [(i, f"text {i} " * (i % 7)) for i in range(200)] + [(7, "again")] * 30 + [(None, None)] * 2
    df = spark.createDataFrame(data, "doc_id long, text string")
    one = lambda seed, key, shard: spark.range(1).select(F.xxhash64(F.lit(seed), F.lit(key).cast("long"), F.lit(shard).cast("long"))).first()[0]
    got = sharding.shard_documents(df, 3, bucket_bytes=1500).select("record.*", "size", "shard", "bucket", "slot", "grown_shard").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(data)
    for r in {r.doc_id: r for r in got if r.doc_id is None or r.doc_id < 8}.values():
        weights = [(one(42, r.doc_id, s), -s) for s in range(3)]
        assert r.shard == -max(weights)[1] and r.grown_shard == (3 if one(42, r.doc_id, 3) > max(weights)[0] else r.shard)
    assert len({(r.shard, r.grown_shard) for r in got if r.doc_id == 7}) == 1
    for shard in range(3):
        mine = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine))) and [r.bucket for r in mine] == sorted(r.bucket for r in mine)


def test_a_row_that_repeats_spreads_over_buckets(spark):
    hot = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    df = hot.unionByName(spark.createDataFrame([(i, f"other {i}") for i in range(500)], "doc_id long, text string"))
    sharded = sharding.shard_documents(df, 2, bucket_bytes=2000)
    got = sharded.groupBy("shard", "bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert sum(r.n for r in got) == 3500 and max(r.bytes for r in got) < 40_000 < 3000 * 29
    for shard in (0, 1):
        assert max(r["last"] for r in got if r.shard == shard) + 1 == sum(r.n for r in got if r.shard == shard)
    runs = [sorted(tuple(r) for r in sharding.shard_documents(df.repartition(n), 2, bucket_bytes=2000).select("record.doc_id", "record.text", "shard", "slot").collect()) for n in (2, 5)]
    assert runs[0] == runs[1]


def test_sharding_of_nothing(empty):
    assert sharding.shard_documents(empty, 4).count() == 0


def test_shards_are_shuffled(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.shard_documents(df, 2, bucket_bytes=8000).where("shard = 0").orderBy("slot").select("record.doc_id").toPandas()["doc_id"].to_numpy()
    assert 1800 < len(got) < 2200 and abs(np.corrcoef(np.arange(len(got)), got)[0, 1]) < 0.1


def test_written_shards_keep_clashing_columns(spark, docs, rows, tmp_path):
    more = docs.withColumn("_slot", F.lit("s")).withColumn("Bucket", F.lit("b")).withColumn("a.b", F.lit("d"))
    sharding.write_shards(sharding.shard_documents(more, 3), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows) and {"shard", "shard_", "_slot", "_slot_", "Bucket_", "a.b", "size", "doc_id"} <= set(back.columns)
    assert {r[0] for r in back.select("shard_").distinct().collect()} == {r[4] for r in rows}
    assert back.groupBy("shard").agg((F.max("_slot") + 1 - F.count("*")).alias("gap")).where("gap != 0").count() == 0


# -- 2 personal data


def base_spans(text):
    """The four expressions by Python's own engine."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(x):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(x))]
        return sum(v - 9 * (v > 9) for v in twice) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    valid = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 8 <= len(digits(m)) <= 15}
    return [(i, m.start(), m.end()) for i, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, text or "") if valid[k](m.group())]


TROUBLE = [
    "a@b.co_x@d.e f@g", "x..y@-a-.b..c 1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255", "4111 1111-1111 1111 4111111111111111 5", "+1 (017) 555-7713. +12 +1234567 +44 20 7946 0958-",
    "é 漢字 ana@ex.org 𝔘 10.0.0.1 4242-4242-4242-4242 4242\x014242\x014242\x014242", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 " * 300, "a" * 3000 + "@b", "9" * 4000, "a@b" + ".c" * 500,
    "@@ . + +1( 1-", "00000000000000000000.1.1.1", "12@x.org 10.1.2.3 " * 9000,
]


def test_base_entities(spark, docs, rows):
    rng = random.Random(1)
    texts = TROUBLE + ["".join(rng.choice("ab@.-+ 0123456789()4") for _ in range(300)) for _ in range(150)]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = pii.personal_data(docs.select("doc_id", "text").unionByName(extra)).collect()
    held = {r[0]: r[1] for r in rows} | {1000 + i: t for i, t in enumerate(texts)}
    assert len(got) == len(rows) + len(texts)
    for r in got:
        if r.key is not None:
            assert [(x.kind, x.start, x.stop) for x in r.base] == base_spans(held[r.key]), held[r.key][:200]
            assert all(not (x.start < y.stop and y.start < x.stop) for x in r.discovered for y in r.base)


def test_context_discovers_unseen_identifiers(spark):
    seeds = [(i, f"some words then contact ann{i}x@mail.org please and more {i}") for i in range(40)]
    planted = [(100, "some words then contact zoë@intern please"), (101, "never zoë2@intern alone")]
    got = {r.key: r.discovered for r in pii.personal_data(spark.createDataFrame(seeds + planted, "doc_id long, text string")).collect()}
    assert [(x.kind, x.value, x.start) for x in got[100]] == [(0, "zoë@intern", 24)] and not got[101] and not got[0]


def test_personal_data_of_nothing(empty):
    assert pii.personal_data(empty).count() == 0


# -- 3 top-k


def brute_top(rows, queries, k):
    out = {}
    for q, v in queries:
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v)))
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("spread", [1, 3, 40, 100_000, 1 << 27])
def test_impact_index_is_exact(spread):
    rng = np.random.default_rng(spread)
    vectors = rng.integers(-spread, spread + 1, (300, 6))
    ids = rng.permutation(300).astype(np.int64)
    index = topk.ImpactIndex(ids, vectors)
    want = brute_top(list(zip(ids.tolist(), vectors.tolist(), strict=True)), [(int(i), v.tolist()) for i, v in zip(ids[:40], vectors[:40], strict=True)], 5)
    for i, got in zip(ids[:40], index.search(vectors[:40], ids[:40], 5), strict=True):
        assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want[int(i)]


def test_bars_skip_and_stop_without_losing_members():
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.integers(-9, 10, (400, 6)), rng.integers(60, 90, (50, 6))])
    ids = rng.permutation(450).astype(np.int64)
    index = topk.ImpactIndex.unpacked(*topk.ImpactIndex(ids, vectors).packed())
    queries, own = vectors[:30], ids[:30]
    whole = index.search(queries, own, 5)
    for rise in (-1, 0):
        bars = np.array([s[-1] + rise for _, s in whole], np.int64)
        for (a, b), (c, d) in zip(whole, index.search(queries, own, 5, bars), strict=True):
            assert a.tolist() == c.tolist() and b.tolist() == d.tolist()
    above = index.search(queries, own, 5, np.array([s[0] + 1 for _, s in whole], np.int64))
    assert all(not len(a) for a, _ in above)


def test_blocks_and_passes_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(i, rng.integers(-40, 41, 5).tolist()) for i in range(700)]
    df = spark.createDataFrame(data, "vec_id long, v array<long>")
    ask = df.where("vec_id % 7 = 0")
    key = lambda r: tuple(r)
    whole = sorted(map(key, topk.exact_top_k(df, ask, 4).collect()))
    want = brute_top(data, [(i, v) for i, v in data if i % 7 == 0], 4)
    assert whole == sorted((q, n, i, s) for q, found in want.items() for n, (i, s) in enumerate(found, 1))
    for name, value in {"BLOCK_ROWS": 64, "QUERY_BYTES": 1500, "TOGETHER": 9, "FIRST_ROWS": 20}.items():
        monkeypatch.setattr(topk, name, value)
    assert sorted(map(key, topk.exact_top_k(df, ask, 4).collect())) == whole


def test_top_k_table(spark):
    rng = random.Random(2)
    data = [(i, [rng.choice([0.5, -0.25, 0.125, 0.3]) for _ in range(4)]) for i in range(120)]
    data += [(200, None), (201, [0.1, None, 0.2, 0.3]), (202, [float("nan")] * 4), (203, [float("inf")] * 4), (None, [1.0] * 4), (204, [1.0, 2.0]), (205, []), (50, [0.5] * 4)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    got = {}
    for r in topk.exact_top_k(df, df.where("vec_id % 50 = 0 and vec_id < 60"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = brute_top(whole, [(q, v) for q, v in whole if q == 0], 5)
    assert got[0] == want[0] and set(got) == {0, 50}
    none = df.where("false")
    assert topk.exact_top_k(none, none, 5).count() == 0 and topk.exact_top_k(df.where("vec_id = 0"), df.where("vec_id = 0"), 5).count() == 0


# -- 4 toxicity


def best_runs(scores):
    """Ruzzo and Tompa's definition: take the best segment, then the same left and right of it."""

    def inside(a, b):
        best = max(((round(sum(scores[i:j]), 9), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return [*inside(a, i), (i, j, best[0]), *inside(j, b)]

    return inside(0, len(scores))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.floats(-6, 6).filter(bool), max_size=30))
def test_segments_are_the_maximal_ones(scores):
    scores = [round(x, 3) + 0.000137 * (i + 1) for i, x in enumerate(scores)]  # no ties, so that places are defined
    got = [(a, b, round(s, 6)) for a, b, s in toxicity.best_segments(np.array(scores, dtype=float))]
    assert got == [(a, b, round(s, 6)) for a, b, s in best_runs(scores)]


@pytest.mark.parametrize("pattern", [[1, -2], [2, -1], [1, -1], [1, -2, 3, -5, 1, -1]])
def test_segments_take_linear_time(pattern):
    begun = time.perf_counter()
    toxicity.best_segments(np.array(pattern * (200_000 // len(pattern)), dtype=float))
    assert time.perf_counter() - begun < 2


def test_level_matches_the_tail_of_clean_segments():
    rng = np.random.default_rng(0)
    words, decay = 100_000, 0.7
    scores = np.concatenate([rng.exponential(1 / decay, 5000), np.full(20, 24.0)])  # a few mislabelled texts
    found = np.bincount((scores * toxicity.SEGMENT_BINS).astype(int), minlength=200)
    level = toxicity.extreme_level(found, decay, words)
    for score in (1.0, 2.0, 4.0):
        assert 0.8 < level * words * np.exp(-decay * score) / (scores >= score).sum() < 2.5
    assert toxicity.extreme_level(np.zeros(9), decay, 50) == 1 / 50


def toxic_corpus(n=300):
    rng = random.Random(3)
    out = []
    for i in range(n):
        bad = i % 6 == 0
        words = sentence(rng, rng.randrange(20, 200)).split()
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = ["vileword", "gamma", "nastything"]
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxic_passages(spark):
    data = toxic_corpus()
    df = spark.createDataFrame([*data, (900, None, None), (901, "", 1), (902, "...", 0), (903, "x " * 30_000, 7)], "doc_id long, text string, label int")
    model = toxicity.fit_word_scores(df.where("doc_id < 200 or doc_id > 800"))
    found = toxicity.toxic_passages(df, model).withColumn("label", F.col("row.label"))
    weights = toxicity.fit_probability(found.where("row.doc_id < 200"))
    got = {r.doc_id: r for r in found.select("row.doc_id", "passages", toxicity.probability(weights).alias("p")).collect()}
    assert len(got) == df.count() and all(0 <= r.p <= 1 for r in got.values())
    for i, text, bad in data[200:]:
        assert (got[i].p >= 0.5) == bool(bad)
        assert got[i].passages or not bad
        for p in got[i].passages:
            assert "vileword" in text[p.start : p.end] or "nastything" in text[p.start : p.end]
    assert not got[900].passages and not got[901].passages
    assert sum(bool(got[i].passages) for i, _, bad in data if not bad) <= 0.02 * len(data)


def test_fit_scores_unseen_rows(spark, empty):
    data = toxic_corpus(240)
    df = spark.createDataFrame(data, "doc_id long, text string, label int")
    model, weights = toxicity.fit(df.where("doc_id < 160"))
    found = toxicity.toxic_passages(df.where("doc_id >= 160"), model)
    got = {r.doc_id: r.p for r in found.select("row.doc_id", toxicity.probability(weights).alias("p")).collect()}
    assert sum((got[i] >= 0.5) == bool(bad) for i, _, bad in data[160:]) >= 78
    model, weights = toxicity.fit(empty.select("doc_id", "text", F.lit(None).cast("int").alias("label")))
    assert 0 <= toxicity.toxic_passages(df, model).select(toxicity.probability(weights).alias("p")).first().p <= 1


def test_toxicity_without_both_labels(spark, empty):
    df = spark.createDataFrame([(1, "a b", 0)], "doc_id long, text string, label int")
    for rows in (df, df.where("false")):
        found = toxicity.toxic_passages(df, toxicity.fit_word_scores(rows)).withColumn("label", F.col("row.label"))
        p = found.select(toxicity.probability(toxicity.fit_probability(found.where("false"))).alias("p")).first().p
        assert 0 <= p <= 1
    assert toxicity.toxic_passages(empty, toxicity.fit_word_scores(df)).count() == 0


# -- 5 quality


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(0)
    total = rng.integers(1, 5, 7).astype(float)
    positive = np.floor(total * rng.random(7))
    got = quality.isotonic(total, positive)
    assert (np.diff(got) >= 0).all()
    grid = sorted({float(sum(positive[a:b]) / sum(total[a:b])) for a in range(7) for b in range(a + 1, 8)})
    loss = lambda f: sum(t * (p / t - x) ** 2 for t, p, x in zip(total, positive, f, strict=True))
    assert loss(got) <= min(loss(f) for f in itertools.combinations_with_replacement(grid, 7)) + 1e-9


def test_quality_of_unseen_documents(spark):
    rng = random.Random(4)
    data = []
    for i in range(400):
        good = i % 4 > 0
        data.append((i, sentence(rng, rng.randrange(30, 300)) if good else " | ".join(rng.choice(WORDS) for _ in range(60)) + "###", int(good)))
    data += [(500, None, None), (501, "", 1), (502, "x" * 200_000, 3)]
    df = spark.createDataFrame(data, "doc_id long, text string, label int")
    rows = quality.with_statistics(df).select("row.*", "statistics")
    model = quality.fit_quality(rows.where("doc_id < 200"))
    got = {r.doc_id: r.score for r in quality.scored(rows, model).collect()}
    assert len(got) == len(data) and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in data[200:400])
    assert quality.scored(rows, quality.fit_quality(rows.where("false"))).first().score == 0.5
    assert quality.scored(rows.where("false"), model).count() == 0


def test_normal_equations_match_a_direct_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, quality.STATISTICS))
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y, strict=True)], "statistics array<double>, label int").repartition(5)
    m = quality.fit_quality(df)
    z, w = m.features(x), np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    direct = np.linalg.solve(z.T @ (z * w[:, None]) + 1e-3 * 200 / quality.FEATURES * np.eye(z.shape[1]), z.T @ (w * y))
    assert np.allclose(m.weights, direct, atol=1e-6)


# -- 6 SimHash


def simhash_slow(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    k = min(3, len(words))
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(rows):
    for r in rows:
        if r[1] is None or len(r[1]) < 5000:
            assert simhash.fingerprint(r[1]) == simhash_slow(r[1])


def test_masks_cover_every_pair_in_the_radius():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    for bits in itertools.combinations(range(64), 3):
        d = sum(1 << b for b in bits)
        assert any(d & m == 0 for m in masks)


def brute_components(values, radius=3):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("most", [1024, 16])
def test_links_join_what_all_pairs_join(spark, most):
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(40)} | {0, 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            v = centre
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(simhash.signed(v) for v in values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {v: v for v in values} | {r.node: r.root for r in simhash.components(simhash.near_links(df, 3, most=most)).collect()}
    assert got == brute_components(values)


def test_near_duplicates_and_what_stays(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {r[0]: simhash.signed(simhash.fingerprint(r[1])) for r in rows if r[0] is not None}
    roots = brute_components(sorted(set(fps.values()) | {simhash.signed(simhash.fingerprint("null id"))}))
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(i, least.get(roots[f], 10**9))
    assert all(r.component == least[roots[r.fp]] for r in got if r.key is not None)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values())) and len(ids) - len(least) == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


# -- 7 mixing


def targets_slow(sizes, share, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, dict(w)
    while True:
        level = (share * sum(sizes.values()) - sum(full.values())) / sum(left.values())
        over = [s for s in left if left[s] * level > most * sizes[s]]
        if not over:
            return full | {s: v * level for s, v in left.items()}
        for s in over:
            full[s] = most * sizes[s]
            del left[s]


def words_in(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("block", [64, 4096])
def test_mix_meets_its_targets(docs, rows, block, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 1 << 10)
    monkeypatch.setattr(mixing, "LOT", 2)
    mix = mixing.mix_sources(docs, block_words=block, bucket_rows=4)
    got = mix.documents.select("row.doc_id", "row.source", "row.size", F.col("size").alias("words"), "source_size", "target", "taken").collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words_in(r[1])
    want = targets_slow(sizes, 1.5, [5, 2, 1], 2.0)
    taken = dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for r in got:
        assert r[6] <= 2 * r[3] and r[4] == sizes[r[1]] and r[5] == pytest.approx(want[r[1]])
        taken[r[1]] += r[6]
    assert all(abs(taken[s] - want[s]) < 5 * 64 for s in sizes)
    assert {r.source: r.words for r in mix.sources.collect()} == taken
    again = mixing.mix_sources(docs.repartition(5), block_words=block, bucket_rows=4).documents
    key = lambda r: (r[0] is None, r[0], r[-1])
    assert sorted((tuple(r) for r in got), key=key) == sorted((tuple(r) for r in again.select("row.doc_id", "row.source", "row.size", "size", "source_size", "target", "taken").collect()), key=key)


def mix_slowly(data, step, block_words):
    """(doc_id: taken words) by walking the schedule slot by slot and block by block, over lists of words."""
    names = sorted({s for *_, s in data}, key=lambda s: (s is None, s or ""))
    streams = {s: [] for s in names}
    for i, text, s in data:
        streams[s] += [i] * words_in(text)
    targets = targets_slow({s: len(v) for s, v in streams.items()}, 1.5, [5, 2, 1], 2.0)
    blocks, needed = {}, {}
    for s in names:
        n = max(1, int(len(streams[s]) / block_words + 0.5)) if streams[s] else 0
        base, longer = divmod(len(streams[s]), n) if n else (0, 0)
        cuts = [k * base + min(k, longer) for k in range(n + 1)]
        blocks[s] = [streams[s][a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        needed[s] = targets[s] * n / len(streams[s]) if n else 0.0
    total, turn, taken = sum(needed.values()), dict.fromkeys(names, 0), Counter()
    for n in range(round(total)):
        u, low = (n + 0.5) * step % 1.0 * total, 0.0
        for s in names:
            low += needed[s]
            if u < low:
                if turn[s] < 2 * len(blocks[s]):
                    taken.update(blocks[s][turn[s] % len(blocks[s])])
                turn[s] += 1
                break
    return taken


@pytest.mark.parametrize("step", [mixing.GOLDEN, 2**0.5 - 1])
def test_slots_of_the_schedule_decide_what_is_taken(spark, monkeypatch, step):
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 1)
    rng = random.Random(11)
    data = [(i, sentence(rng, rng.randrange(1, 80)), rng.choice(["a", "b", "b", "c", None])) for i in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    mix = mixing.mix_sources(df, block_words=16, step=step)
    found = mix.documents.select("row.doc_id", "row.source", "size", "taken", "h").collect()
    # the operator's order of documents: by cell (one here), then by hash
    order = {r.doc_id: k for k, r in enumerate(sorted(found, key=lambda r: r.h))}
    want = mix_slowly(sorted(data, key=lambda r: order[r[0]]), step, 16)
    assert {r.doc_id: r.taken for r in found} == {i: want[i] for i, *_ in data}


def test_another_sequence_takes_other_words(spark):
    rng = random.Random(12)
    df = spark.createDataFrame([(i, sentence(rng, rng.randrange(1, 80)), "abc"[i % 3]) for i in range(90)], "doc_id long, text string, source string")
    golden, other, none = (mixing.mix_sources(df, block_words=16, step=s) for s in (mixing.GOLDEN, 2**0.5 - 1, 0.0))
    taken = [{r.doc_id: r.taken for r in m.documents.select("row.doc_id", "taken").collect()} for m in (golden, other, none)]
    assert taken[0] != taken[1] and taken[0] != taken[2]
    for m in (golden, other):
        assert all(abs(r.words - r.target) < 5 * 16 for r in m.sources.collect())
    one = [r.source for r in none.sources.where("words > 0").collect()]
    assert len(one) == 1  # a sequence that stands still feeds the one source where its point lies


def test_schedule_spreads_sources_evenly(spark):
    df = spark.createDataFrame([(i, "w " * 100, "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    mix = mixing.mix_sources(df, block_words=50)
    slots = [(r.position, r.source) for r in mix.slots.collect()]
    order = [s for _, s in sorted(slots)]
    shares = {s: order.count(s) / len(order) for s in "abc"}
    for n in (50, 100, 400):
        assert all(abs(order[:n].count(s) - n * shares[s]) < 6 for s in "abc")
    turns = mix.slots.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("turn").alias("d"), F.max("turn").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in turns)


def test_mixed_documents_and_nothing(docs, empty):
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and set(Counter(r.doc_id for r in got.collect()).values()) <= {1, 2, 3, 4, 5, 6}
    assert mixing.mix_sources(empty).documents.count() == 0 and mixing.mixed_documents(empty).count() == 0


# -- 8 lines


def deleted_slow(texts, min_words):
    """(doc, line) of every line in a run of enough words that stands earlier too, by trying all runs."""
    docs = []
    for i, t in enumerate(texts):
        docs.append([(j, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for j, x in enumerate((t or "").split("\n"))])
        docs[i] = [x for x in docs[i] if x[2]]
    seen, gone = {}, set()
    for i, doc in enumerate(docs):
        for a in range(len(doc)):
            for b in range(a + 1, len(doc) + 1):
                if sum(x[2] for x in doc[a:b]) >= min_words:
                    key = tuple(x[1] for x in doc[a:b])
                    if key in seen:
                        gone |= {(i, x[0]) for x in doc[a:b]}
                    else:
                        seen[key] = True
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_repeated_runs_are_deleted(spark, seed):
    rng = random.Random(seed)
    pool = ["a b c", "d e", "f", "g h i j", "", "  ", "k l m n o p q r s t u v"]
    passage = ["one two three", "four five six seven", "", "eight nine"]
    texts = []
    for _ in range(14):
        t = [rng.choice(pool) + (f" {rng.randrange(99)}" if rng.random() < 0.3 else "") for _ in range(rng.randrange(14))]
        if rng.random() < 0.5:
            at = rng.randrange(len(t) + 1)
            t[at:at] = passage
        texts.append("\n".join(t))
    texts += [None, "", texts[3], "\n".join(["x y z"] * 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = deleted_slow(texts, 9)
    spans = lines.deleted_spans(df, min_words=9).collect()
    got = {(r.key, i) for r in spans for s in r.spans for i in range(s.first, s.last + 1)}
    assert got == want and {r.key: r.removed for r in spans} == {i: sum(d == i for d, _ in want) for i in range(len(texts))}
    cut = {r.doc_id: r.text for r in lines.drop_repeated_lines(df, min_words=9).collect()}
    assert cut == {i: "\n".join(x for j, x in enumerate((t or "").split("\n")) if (i, j) not in want) for i, t in enumerate(texts)} | {14: cut[14]}


def test_lines_of_troubled_rows(docs, rows, empty):
    spans = lines.deleted_spans(docs).collect()
    assert len(spans) == len(rows)
    assert sum(r.removed > 0 for r in spans if r.key == 12) == 2 * (len(rows[12][1].split()) >= 50)
    got = lines.drop_repeated_lines(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    assert lines.deleted_spans(empty).count() == 0


# -- 9 language


def test_language_model(spark, docs, empty):
    rng = random.Random(6)
    sets = {"aa": "the of and that with from".split(), "bb": "der und die mit nicht von".split(), "cc": "που και για από τον των".split()}
    data = [(i, " ".join(rng.choice(sets[k]) for _ in range(rng.randrange(3, 60))), k) for i in range(240) for k in [list(sets)[i % 3]]]
    data += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !?", None), (903, "und die " * 60_000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.fit_language_model(df.where("doc_id < 120"))
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r.language_prediction for r in language.predict_language(df, model, F.col("text")).collect()}
    assert sum(got[i].lang == k for i, _, k in data[120:240]) >= 118
    assert [got[i].lang for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"] and all(0 <= p.score <= 1 for p in got.values())
    assert language.predict_language(docs, language.fit_language_model(empty), F.col("text")).select("language_prediction.lang").distinct().collect()[0][0] == "und"
    assert language.predict_language(empty, model, F.col("text")).count() == 0


def test_pieces_lose_no_gram(monkeypatch):
    text = "abcdefghij" * 20

    def counts(chunk):
        monkeypatch.setattr(language, "CHUNK", chunk)
        return sum((np.bincount(language._features(h)[0], minlength=language.FEATURES) for h, _ in language._pieces([text])), np.zeros(language.FEATURES, int))

    assert (counts(1 << 18) == counts(7)).all()


# -- 10 decontamination


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        old, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return min(row)


@settings(max_examples=80, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abcd", max_size=40))
def test_bit_parallel_distance(pattern, text):
    assert decontamination.best_match(pattern, text)[0] == least_distance(pattern, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab c", min_size=8, max_size=24), min_size=1, max_size=3), st.text("ab c", max_size=80))
def test_every_item_in_its_errors_is_found(items, text):
    held = [(i, decontamination.normalized(t)) for i, t in enumerate(items)]
    got = {i: d for i, d, _ in decontamination.Matcher(held, 0.25).find(text)}
    low = decontamination.normalized(text)
    want = {i: least_distance(t, low) for i, t in held if t and least_distance(t, low) <= len(t) // 4}
    assert got == want


def test_contaminated_rows(spark, docs, rows, empty):
    rng = random.Random(8)
    item = sentence(rng, 40)
    edited = item.replace("alpha", "aleph", 1).upper()
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "y"), (3, "", "z"), (4, sentence(rng, 40), "q"), (1, item, "x")], "item_id long, text string, doc_id string")
    more = spark.createDataFrame([(800, f"before {edited}\n after"), (801, item[: len(item) // 2])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = decontamination.benchmark_matches(both, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(800, 1)} and len(got) == 2
    kept = decontamination.drop_contaminated(both, bench)
    assert kept.count() == both.count() - 1 and kept.columns == both.columns
    assert decontamination.benchmark_matches(empty, bench).count() == 0 and decontamination.benchmark_matches(docs, bench.where("false")).count() == 0


def test_blocks_of_items_give_the_same(spark, docs, monkeypatch):
    bench = docs.select(F.col("doc_id").alias("item_id"), F.substring("text", 10, 120).alias("text")).where("length(text) > 60")
    keys = lambda: sorted(tuple(r) for r in decontamination.benchmark_matches(docs.where("doc_id > 5"), bench.where("item_id > 5")).collect())
    whole = keys()
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 500)
    assert keys() == whole and whole


# -- shared


def test_held_out_is_crc32_of_the_id(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), None]], T.StructType([T.StructField("doc_id", T.LongType())]))
    for r in df.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("h")).collect():
        assert r.h == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)


def test_base_digest_of_no_spans(spark):
    assert spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0] == hashlib.sha256(b"").hexdigest()


CLASHING = "doc_id long, text string, label int, row string, h string, nth string, key string, base string, discovered string, words string, passages string, surprise string, statistics array<double>, score string, bin string, language_prediction string, `a.b` string, lang string"


@pytest.fixture(scope="module")
def clashing(spark):
    """Repeated rows, nulls and columns that are called as the operators call theirs."""
    rng = random.Random(21)
    out = []
    for i in range(60):
        bad = i % 3 == 0
        text = sentence(rng, 40) + (" vileword nastything" if bad else "") + (f" mail a{i}@x.org" if i % 2 else "")
        out.append((i, text, int(bad), *["q"] * 9, None, *["q"] * 4, ["en", "de"][i % 2]))
    out += [out[3]] * 3 + [(900, None, None, *[None] * 15), (901, "", 1, *["z"] * 9, None, *["z"] * 5)]
    return spark.createDataFrame(out, CLASHING)


def test_clashing_columns_and_repeated_rows(clashing):
    n = clashing.count()
    found = pii.personal_data(clashing)
    assert found.count() == n and len({str(r.base) for r in found.where("key = 3").collect()}) == 1
    model = toxicity.fit_word_scores(clashing)
    passages = toxicity.toxic_passages(clashing, model)
    assert passages.count() == n and passages.where("row.doc_id = 3").select("surprise").distinct().count() == 1
    assert "passages" in passages.schema["row"].dataType.names
    weights = toxicity.fit_probability(passages.withColumn("label", F.col("row.label")))
    assert passages.select(toxicity.probability(weights).alias("p")).where("p between 0 and 1").count() == n
    scored = quality.scored(clashing.withColumn("statistics", quality.text_statistics("text")), quality.fit_quality(clashing.withColumn("statistics", quality.text_statistics("text"))))
    assert scored.count() == n and {"score", "score_", "a.b"} <= set(scored.columns) and scored.where("score between 0 and 1").count() == n
    assert scored.where("doc_id = 3").select("score").distinct().count() == 1
    predicted = language.predict_language(clashing, language.fit_language_model(clashing), F.col("text"))
    assert predicted.count() == n and {"language_prediction", "language_prediction_"} <= set(predicted.columns)
    assert predicted.where("language_prediction_ = 'q'").count() == 63 and predicted.where("doc_id = 3").select("language_prediction").distinct().count() == 1
    kept = decontamination.drop_contaminated(clashing, clashing.where("doc_id = 3").select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("key")))
    assert kept.columns == clashing.columns and kept.count() == n - 4
    assert decontamination.benchmark_matches(clashing, clashing.where("doc_id = 3").select(F.col("doc_id").alias("item_id"), "text").limit(1)).count() == 4


def slow_bayes(train, texts, smoothing=0.5):
    """Naive Bayes by dictionaries of the n-grams' features; collisions as in the operator."""
    counts = {}
    grams = lambda t: Counter(int(x) for held, _ in language._pieces([t]) for x in language._features(held)[0])
    for text, lang in train:
        counts.setdefault(lang, Counter()).update(grams(text))
    out = []
    for text in texts:
        sums = {}
        for lang in sorted(counts):
            total = sum(counts[lang].values()) + smoothing * language.FEATURES
            sums[lang] = sum(n * np.log((counts[lang][f] + smoothing) / total) for f, n in grams(text).items())
        best = max(sums, key=lambda x: (sums[x], [-ord(c) for c in x]))
        out.append((best, 1 / sum(np.exp(v - sums[best]) for v in sums.values())))
    return out


def test_language_by_brute_force(spark):
    rng = random.Random(7)
    sets = {"aa": "the of and that with from".split(), "bb": "der und die mit nicht von".split(), "cc": "el la de y en que".split()}
    data = [(i, " ".join(rng.choice(sets[k] + ["zz"]) for _ in range(rng.randrange(1, 9))), k) for i in range(60) for k in [rng.choice(list(sets))]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.fit_language_model(df.where("doc_id < 30"))
    got = {r.doc_id: r.language_prediction for r in language.predict_language(df, model, F.col("text")).collect()}
    want = slow_bayes([(t, k) for i, t, k in data if i < 30], [t for _, t, _ in data])
    for (i, *_), (lang, score) in zip(data, want, strict=True):
        assert got[i].lang == lang and got[i].score == pytest.approx(score, rel=1e-4)
