"""The registered corpus queries and the pipeline over the smallest tables."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import base_spans, brute_components, simhash_slow, targets_slow, words_in

import corpus_pipeline
from multifactor.llm import pii, queries
from multifactor.llm.simhash import signed

COLUMNS = {
    "op1_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op2_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op7_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_lines": {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "removed_lines": "string"},
    "op9_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_decontamination": {"doc_id": "bigint", "item_id": "bigint", "distance": "int", "match_end": "bigint"},
    "op11_resampling": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op12_trie": dict.fromkeys(["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"], "bigint") | {"ends_sha256": "string"},
    "op13_page_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


@pytest.mark.parametrize("name", queries.queries())
def test_query_covers_its_whole_table(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    assert COLUMNS[name].items() <= dict(df.dtypes).items()
    rows = df.toPandas()
    if name in ("op3_top_k", "op10_decontamination", "op12_trie"):
        assert len(rows)
    elif name == "op13_page_text":
        assert sorted(rows["page_id"]) == sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id").collect())
    else:
        ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").toPandas()["doc_id"]
        assert sorted(rows["doc_id"]) == sorted(ids)
    parts = {"op4_toxicity": (5, 0), "op5_quality": (3, 1), "op9_language": (4, 2)}
    if name in parts:
        n, k = parts[name]
        assert [zlib.crc32(str(i).encode()) % n == k for i in rows["doc_id"]] == rows["held_out"].tolist() and rows["score"].between(0, 1).all()


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_matches_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "sharding":
            assert out.columns == docs.columns
        docs = corpus_pipeline.stored(out)
        after = docs.count()
        assert {"mixing": True, "sharding": after == before}.get(name, 0 < after < before)
        before = after
    assert docs.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("gap")).where("gap != 0").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == before


@pytest.mark.parametrize("stage", dict(corpus_pipeline.STAGES))
def test_stages_take_an_empty_table(spark, sf_dir, stage):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    assert dict(corpus_pipeline.STAGES)[stage](spark, none, sf_dir).count() == 0


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.select("*", *[F.lit(n).alias(n) for n in ("shard", "slot", "record", "statistics", "score", "label", "h", "a.b", "copies", "size")])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, sf_dir)
        want = [{"shard": "shard_", "slot": "slot_"}.get(c, c) for c in more.columns] + ["shard", "slot"] if name == "sharding" else more.columns
        assert out.columns == want and out.where("`a.b` = 'a.b'").count() == out.count() > 0


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()}


def test_sizes_sums_and_slots_of_shards(spark, sf_dir, texts):
    slots = {}
    for r in queries.op1_sharding(spark, sf_dir).collect():
        raw = (texts[r.doc_id][0] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) and 0 <= s < 40 for s, v in slots.items())


def test_digests_and_spans_of_personal_data(spark, sf_dir, texts):
    for r in queries.op2_pii(spark, sf_dir).collect():
        base = base_spans(texts[r.doc_id][0])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(base))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, *_ in base) for i in range(4)]
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {(pii.KINDS.index(k), int(a), int(b)) for k, a, b in spans} >= set(base) and len(spans) == len(base) + r.n_discovered == r.n_spans
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))


def test_fingerprints_and_components(spark, sf_dir, texts):
    prints = {i: simhash_slow(t) for i, (t, _) in texts.items()}
    roots, least = brute_components(sorted({signed(p) for p in prints.values()})), {}
    for i, p in prints.items():
        least[roots[signed(p)]] = min(i, least.get(roots[signed(p)], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{p:016x}", least[roots[signed(p)]]) for i, p in prints.items()}


def test_targets_and_words_of_the_mix(spark, sf_dir, texts):
    sizes, taken = {}, {}
    for t, s in texts.values():
        sizes[s] = sizes.get(s, 0) + words_in(t)
    want = targets_slow(sizes, 1.5, [5, 2, 1], 2.0)
    for r in queries.op7_mixing(spark, sf_dir).collect():
        text, source = texts[r.doc_id]
        assert (r["size"], r.source_size) == (words_in(text), sizes[source]) and r.target == pytest.approx(want[source]) and 0 <= r.taken <= 2 * r["size"]
        taken[source] = taken.get(source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= max(8, 0.01 * want[s]) for s in sizes)
