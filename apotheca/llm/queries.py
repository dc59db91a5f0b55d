"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apotheca.llm import bpe, collocations, embedding_dedup, hard_negatives, line_crf, main_text, minhash, nearest, oracles, packing, personal_data, quality_rules, sharding, url_filter
from apotheca.llm.scratch import Table, shared_folder, small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str) -> line_crf.Model:
    return line_crf.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=~held_out())


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = line_crf.score_documents(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def _listed(spans: str):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal_data.find_personal_data(docs, personal_data.fit(docs))
    return found.select("doc_id", *map(_count, personal_data.KINDS), F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality_rules.repetition_stats(table(spark, sf_dir, "documents"))
    first = ["doc_id", *quality_rules.COUNTS, "base_failed", "kept"]
    return stats.select(*first, *(c for c in stats.columns if c not in first))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.vector_groups(table(spark, sf_dir, "embeddings"))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with a checksum of each piece's ids.

    Written once, so that few texts at a time go to Python: a batch is held by the JVM and by the worker, in buffers of twice its size.
    """
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    with small_batches(docs.sparkSession, 1000):
        return Table(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"), "packed").df


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicate_groups(table(spark, sf_dir, "documents"), options=minhash.Options(words=4))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, appended in 16 arrivals by source, compacted, and read back through the last manifest.

    Its rows are the documents, for which shard holds which depends on sizes; ``tests/llm`` looks at shards and manifests.
    """
    store = sharding.ShardStore(spark, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")
    store.append(table(spark, sf_dir, "documents"), arrival=F.pmod(F.xxhash64("source"), F.lit(16)))
    version = store.compact().version
    store.vacuum()
    return store.read(version).select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, pattern)
    decoded = bpe.decode_documents(encoded, ranks, pattern)
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = main_text.extract_text(pages, main_text.fit(pages), keep=["url"])
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids that 7 divides are moved on by one, as the contract has it."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.mine_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label_col=label)


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_personal_data": op2_personal_data,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_packing": op6_packing,
    "op7_minhash": op7_minhash,
    "op8_sharding": op8_sharding,
    "op9_bpe": op9_bpe,
    "op10_main_text": op10_main_text,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_nearest": op13_nearest,
}

#: Of the queries that SQL can express; tests/llm holds the others against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": url_filter.oracle_sql(),
    "op4_quality_rules": oracles.repetition(quality_rules.Limits()),
    "op5_embedding_dedup": oracles.vectors(0.93),
    "op7_minhash": oracles.minhash(4, 80),
    "op8_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "op11_collocations": collocations.oracle_sql(),
    "op12_hard_negatives": hard_negatives.oracle_sql(),
}
