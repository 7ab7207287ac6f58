"""One query per operator over its whole table, with the columns their contracts name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import decontaminate, embed_join, line_dedup, ngram_join, packing, pii, prefix_trie, quality, secrets, suffix_dedup, token_counts, warc, whitening
from wardline.llm.common import Scratch
from wardline.llm.oracles import ORACLES  # noqa: F401

PACK_TOKENIZER = "byte_bpe_50k.json"
COUNT_VOCABULARY = "piece_bpe_32k.model"


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record per page, read the archives, join the transactions, report what came back."""
    scratch = Scratch(spark, "warc")
    warc.write_captures(table(spark, sf_dir, "pages"), scratch.path("archives"), scratch)
    captures = warc.assemble(warc.read_records(spark, scratch.path("archives")))
    own = F.col("warc_type") == "response"
    payload = F.col("response.payload")
    facts = captures.select(
        "capture_id",
        "refers_to",
        "warc_type",
        warc.metadata_field("capture-key").cast("long").alias("page_id"),
        F.when(own, F.octet_length(payload).cast("long")).alias("bytes"),
        F.when(own, warc.base32_sha1(payload)).alias("digest"),
    )
    facts = scratch.save(facts, "facts")
    referred = facts.where(own).select(
        F.col("capture_id").alias("refers_to"),
        F.col("page_id").alias("to_page"),
        F.col("bytes").alias("to_bytes"),
        F.col("digest").alias("to_digest"),
    )
    return facts.join(referred, "refers_to", "left").select(
        "page_id",
        F.coalesce("bytes", "to_bytes").alias("payload_bytes"),
        F.coalesce("digest", "to_digest").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.col("to_page").alias("refers_to"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = embed_join.link_vectors(table(spark, sf_dir, "embeddings"))
    ids = done.select("_rid", "links", "component", F.col("_row.vec_id").alias("vec_id"))
    heads = ids.where("_rid = component").select("component", F.col("vec_id").alias("component_id"))
    return ids.join(heads, "component").select(
        "vec_id", F.col("links").alias("n_links"), "component_id", (F.col("_rid") == F.col("component")).alias("kept")
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_file(PACK_TOKENIZER)).drop("_rid")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item that it holds, as it is or with other parameters."""
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = ["item_tokens", "covered", "slots", "renamed", "kind"]
    return leaks.select(F.col("_key").alias("doc_id"), F.col("item").alias("item_id"), *names)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select(F.col("_key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_file(COUNT_VOCABULARY))


HEADS = {"low_quality": "1 - quality", "toxic": "toxic"}


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = quality.judge(docs, labels, HEADS, whole_rows=False)
    return judged.select(F.col("_key").alias("doc_id"), *[c for c in judged.columns if c[0] != "_"])


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ngram_join.link_documents(table(spark, sf_dir, "documents"))
    # Components are numbered by rows; the smallest row's document names them.
    ids = done.select("_rid", "n_shingles", "component", F.col("_row.doc_id").alias("doc_id"))
    heads = ids.where("_rid = component").select("component", F.col("doc_id").alias("component_id"))
    return ids.join(heads, "component").select("doc_id", "n_shingles", "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_spans(table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "trie")
    turns, heads = prefix_trie.rebuild(prefix_trie.turn_rows(table(spark, sf_dir, "conversations")), scratch)
    nodes = prefix_trie.prefix_trie(turns, heads, scratch)
    names = {"conv": "conv_id", "parent_conv": "parent_conv_id", "saved": "saved_tokens", "ends": "ends_sha256"}
    return nodes.withColumnsRenamed(names)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(whitening.integer_vectors(table(spark, sf_dir, "embeddings"))).withColumnRenamed("key", "vec_id")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_line_dedup": op2_line_dedup,
    "op3_embeddings": op3_embeddings,
    "op4_packing": op4_packing,
    "op5_decontamination": op5_decontamination,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_ngram_join": op9_ngram_join,
    "op10_secrets": op10_secrets,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_pii": op13_pii,
}
