"""The thin opN_<name> queries over the test tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from siltstone.llm import bpe, chat, multiindex, multiset, packing, quality, sharding, simhash, substring, wrapper
from siltstone.llm.common import scratch_dir, table


def op1_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9, recall=0.99)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = f"{scratch_dir(spark)}/siltstone-slots-{uuid.uuid4().hex}"
    dealt = sharding.shard(table(spark, sf_dir, "documents"), shards=24, store=store)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )


def op3_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multiset.edited_fingerprints(table(spark, sf_dir, "documents"), {"edited_sha256": F.sha2("edited", 256)})
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        multiset.digits(F.col("fp")).alias("fingerprint"),
        multiset.digits(F.col("edited_fp")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), most=4096, axes=32, neighbours=15)
    scored = quality.with_score(docs, model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = chat.read_back(chat.format_records(chat.records_of_rows(rows.unionByName(extra)), "conv_id"), "conv_id")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(chat.turns_text(F.col("turns")), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3).select("doc_id", "fingerprint", "component_id")


def op10_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper.main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_multiindex": op1_multiindex,
        "op2_sharding": op2_sharding,
        "op3_multiset": op3_multiset,
        "op4_packing": op4_packing,
        "op5_quality": op5_quality,
        "op6_substring": op6_substring,
        "op7_chat": op7_chat,
        "op8_bpe": op8_bpe,
        "op9_simhash": op9_simhash,
        "op10_wrapper": op10_wrapper,
        "pipeline": pipeline,
    }


OP1_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a, e b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(id, root) AS (SELECT a, a FROM pairs UNION SELECT b, b FROM pairs UNION SELECT pairs.b, reach.root FROM reach JOIN pairs ON pairs.a = reach.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN roots ON roots.id = vec_id"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, len(w) AS n FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, n - 49)) AS i FROM x WHERE n >= 50)),
gone AS (SELECT win.doc_id, i FROM win JOIN (SELECT s, min(doc_id) AS least FROM win GROUP BY s) m ON win.s = m.s WHERE m.least < win.doc_id),
off AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM gone),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM x),
kept AS (SELECT words.doc_id, count(off.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (off.i IS NULL) AS t FROM words LEFT JOIN off ON words.doc_id = off.doc_id AND words.i = off.i GROUP BY words.doc_id)
SELECT x.doc_id, n AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM x LEFT JOIN kept ON x.doc_id = kept.doc_id"""

OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body,
  replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ') + length(head) + length(': ') + length(body) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def oracle_sql() -> dict:
    return {"op1_multiindex": OP1_SQL, "op6_substring": OP6_SQL, "op7_chat": OP7_SQL}
