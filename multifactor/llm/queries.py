"""One registered query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from multifactor.llm import decontamination, language, lines, mixing, pagetext, pii, quality, resample, sharding, simhash, topk, toxicity, trie
from multifactor.llm.common import bounded_labels, held_out, read_table

SHARDS = 40


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law ``key``."""
    sharded = sharding.shard_documents(read_table(spark, sf_dir, "documents"), SHARDS)
    return sharded.select(
        "record.doc_id", "size", F.crc32(F.coalesce("record.text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard", F.col("bucket").cast("int").alias("bucket"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    found = pii.personal_data(read_table(spark, sf_dir, "documents"))
    kind = f"element_at(array({', '.join(repr(k) for k in pii.KINDS)}), x.kind + 1)"
    base = F.expr(f"transform(array_sort(transform(base, x -> named_struct('kind', x.kind, 'start', x.start, 'stop', x.stop))), x -> concat_ws(':', {kind}, x.start, x.stop))")
    every = F.expr(f"""transform(array_sort(concat(transform(base, x -> named_struct('kind', x.kind, 'start', x.start, 'stop', x.stop)),
        transform(discovered, x -> named_struct('kind', x.kind, 'start', x.start, 'stop', x.stop)))), x -> concat_ws(':', {kind}, x.start, x.stop))""")
    count = [F.size(F.expr(f"filter(base, x -> x.kind = {i})")).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.BASE_KINDS)]
    return found.select(
        F.col("key").alias("doc_id"), *count, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"),
        F.size(F.expr("filter(discovered, x -> x.kind = 4)")).cast("long").alias("n_secret"), F.size("discovered").cast("long").alias("n_discovered"),
        (F.size("base") + F.size("discovered")).cast("long").alias("n_spans"),
    )


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every vector whose id is divisible by 50."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def _labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``docs`` with their label; a document with several labels gets their maximum, one without gets none."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    return docs.join(known, "doc_id", "left")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being toxic, learned from labels outside the held-out fifth."""
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 5, 0)
    learned = bounded_labels(labels.where(~out), "toxic", toxicity.FIT_ROWS)
    model, weights = toxicity.fit(docs.where(~out).join(learned, "doc_id"))
    found = toxicity.toxic_passages(docs, model).withColumn("doc_id", F.col("row.doc_id"))
    score = toxicity.probability(weights)
    passages = F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p.start, p.end)), ",")
    return found.select("doc_id", out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), passages.alias("passages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being of good quality, learned from labels outside the held-out third."""
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 3, 1)
    rows = quality.with_statistics(docs).select("row.doc_id", "statistics")
    model = quality.fit_quality(_labelled(rows.where(~out), labels.where(~out), "quality"))
    scored = quality.scored(rows, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the least id of its near-duplicates."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mix = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mix.documents.select("row.doc_id", "size", "source_size", "target", "taken", "row.source")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines that later copies of repeated runs take up."""
    spans = lines.deleted_spans(read_table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"], s["last"])), ",")
    return spans.select(F.col("key").alias("doc_id"), F.col("lines").cast("long").alias("n_lines"), F.col("removed").cast("long").alias("n_removed"), text.alias("removed_lines"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from documents outside the held-out quarter."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    model = language.fit_language_model(docs.where(~out))
    found = language.predict_language(docs.select("doc_id", "text"), model, F.col("text"))
    return found.select("doc_id", out.alias("held_out"), F.col("language_prediction.lang").alias("lang_pred"), F.col("language_prediction.score").alias("score"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item that stands in a document, with its edit distance."""
    return decontamination.benchmark_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance for the benchmark's distribution of words, and the tenth that is drawn."""
    found = resample.resampling_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank", "n_words")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations."""
    nodes = trie.conversation_trie(read_table(spark, sf_dir, "conversations"))
    return nodes.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return pagetext.extracted(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


_OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

_OP8_SQL = """
with split_up as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as all_lines from documents
), every as (
  select doc_id, unnest(all_lines) as content, unnest(range(len(all_lines))) as line from split_up
), worded as (
  select *, len(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+')) as words from every
), numbered as (
  select *, row_number() over d as i, sum(words) over (d rows unbounded preceding) as total from worded where words > 0
  window d as (partition by doc_id order by line)
), runs as (
  select a.doc_id, a.i as a, min(b.i) as b from numbered a join numbered b on a.doc_id = b.doc_id and b.i >= a.i and b.total - a.total + a.words >= 50 group by all
  union
  select b.doc_id, max(a.i) as a, b.i as b from numbered a join numbered b on a.doc_id = b.doc_id and b.i >= a.i and b.total - a.total + a.words >= 50 group by b.doc_id, b.i
), filled as (
  select r.doc_id, r.a, r.b, string_agg(n.content, chr(10) order by n.i) as content from runs r join numbered n on n.doc_id = r.doc_id and n.i between r.a and r.b group by all
), ordered as (
  select *, row_number() over (partition by content, b - a order by doc_id, a) as copy from filled
), gone as (
  select distinct n.doc_id, n.line from ordered o join numbered n on n.doc_id = o.doc_id and n.i between o.a and o.b where o.copy > 1
), grouped as (
  select doc_id, line, line - row_number() over (partition by doc_id order by line) as grp from gone
), spans as (
  select doc_id, min(line) as f, max(line) as l, count(*) as n from grouped group by doc_id, grp
), by_doc as (
  select doc_id, sum(n) as n, string_agg(concat(f, '-', l), ',' order by f) as s from spans group by doc_id
)
select d.doc_id, cast(len(d.all_lines) as bigint) as n_lines, cast(coalesce(b.n, 0) as bigint) as n_removed, coalesce(b.s, '') as removed_lines
from split_up d left join by_doc b on d.doc_id = b.doc_id
"""


#: CRC-32 in SQL: a table of bytes' remainders, and a fold over a text's UTF-8 bytes (``crc(h)`` takes their hex digits).
_CRC_SQL = """
crc_table as (
  select list(r order by n) as entries from (
    select n, list_reduce(list_concat([n], range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as r from (select unnest(range(256)) as n)
  )
)
"""


def _crc(words: str, name: str, word: str) -> str:
    """SQL of ``word`` and ``crc`` for the distinct values of ``word`` in the table ``words``, under ``name``."""
    return f"""
{name} as (
  select {word}, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, len(hex(encode({word}))), 2), lambda i: cast('0x' || substr(hex(encode({word})), i, 2) as bigint))),
    lambda c, b: xor(c // 256, entries[xor(c % 256, b) + 1]))) as crc
  from (select distinct {word} from {words}), crc_table
)"""


_OP11_SQL = f"""
with {_CRC_SQL}, texts as (
  select doc_id, true as source, text from documents union all select item_id, false, text from benchmark
), words as (
  select doc_id, source, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from texts
), {_crc("words", "crcs", "word")}, counted as (
  select doc_id, source, crc % 10000 as bucket, count(*) as n from words join crcs using (word) group by all
), buckets as (
  select bucket, coalesce(sum(n) filter (where source), 0) as s, coalesce(sum(n) filter (where not source), 0) as t from counted group by bucket
), totals as (
  select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from buckets
), gains as (
  select bucket, floor(1000 * ln(cast((t + 1) * (s_all + 10000) as double) / cast((s + 1) * (t_all + 10000) as double))) as gain from buckets, totals
), weights as (
  select doc_id, sum(n) as n_features, sum(n * gain) as weight from counted join gains using (bucket) where source group by doc_id
), scored as (
  select d.doc_id, cast(coalesce(n_features, 0) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
    cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) as bigint) + 0.5) / cast(4294967296 as double)))) as bigint) as score
  from documents d left join weights w on d.doc_id = w.doc_id
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as m from scored where n_features >= 20
)
select s.*, case when r <= 10 * m // 100 then r end as rank, n_features as n_words from scored s left join ranked r on s.doc_id = r.doc_id
"""


_OP12_SQL = f"""
with {_CRC_SQL}, said as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as pos
  from conversations where conv_id is not null
), ids as (
  select distinct conv_id, cast(conv_id as varchar) as word from said
), {_crc("ids", "crcs", "word")}, headed as (
  select conv_id, crc % 6 as h from ids join crcs using (word)
), parts as (
  select i.conv_id, 0 as own, s.pos, s.role, s.text from headed i join said s on s.conv_id = i.conv_id - i.conv_id % 100 and s.pos <= i.h
  union all
  select i.conv_id, 1, s.pos, s.role, s.text from headed i join said s on s.conv_id = i.conv_id and s.pos > i.h
), rebuilt as (
  select conv_id, row_number() over (partition by conv_id order by own, pos) as depth, md5(concat(length(role), ':', role, text)) as mark, length(text) as size from parts
), places as (
  select conv_id, depth, string_agg(mark, '') over (partition by conv_id order by depth rows unbounded preceding) as path, size from rebuilt
  union all select conv_id, 0, '', 0 from ids
), lasts as (
  select conv_id, max(depth) as last from places group by conv_id
), nodes as (
  select depth, path, min(conv_id) as conv_id, count(*) as n_convs, max(size) as size, case when depth > 0 then substr(path, 1, length(path) - 32) end as up from places group by depth, path
), ends as (
  select depth, path, string_agg(conv_id, ',' order by conv_id) as ids from places join lasts using (conv_id) where depth = last group by depth, path
), children as (
  select up as path, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by up, depth
), full_nodes as (
  select n.*, coalesce(c.n_children, 0) as n_children from nodes n left join children c on n.path = c.path and n.depth = c.depth
), below as (
  select p.depth, p.path, sum((n.n_convs - 1) * n.size) as saved, count(*) filter (where n.n_children = 0) as leaves
  from full_nodes n join places p on p.conv_id = n.conv_id and p.depth <= n.depth group by p.depth, p.path
)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, n.n_children, cast(b.leaves as bigint) as n_leaves, cast(b.saved as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from full_nodes n join below b on n.path = b.path and n.depth = b.depth left join full_nodes u on u.path = n.up and u.depth = n.depth - 1 left join ends e on e.path = n.path and e.depth = n.depth
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The operators' queries by name."""
    found = (op1_sharding, op2_pii, op3_top_k, op4_toxicity, op5_quality, op6_simhash, op7_mixing, op8_lines, op9_language, op10_decontamination, op11_resampling, op12_trie, op13_page_text)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express."""
    return {"op3_top_k": _OP3_SQL, "op8_lines": _OP8_SQL, "op11_resampling": _OP11_SQL, "op12_trie": _OP12_SQL}
