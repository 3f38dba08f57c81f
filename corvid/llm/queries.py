"""The registered queries of this subpackage: ``fn(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from corvid.llm import centroids, decontaminate, language, licenses, lines, mixing, negatives, quality, repeats, rules, similar, tokens, warc
from corvid.llm.shared import read_table, work_dir


def op1_warc(spark, sf_dir):
    """A record for every page, read back from the archives."""
    return warc.archive_pages(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_ids(spark, sf_dir):
    """Byte-level BPE ids of every document, read back from the sequence files."""
    return tokens.tokenize_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality_classifier(spark, sf_dir):
    """Score of every document by the byte network learned from rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, net).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                                           (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_line_dedup(spark, sf_dir):
    """Lines of 40 code points or more in 5 documents or more stay in the last one only."""
    docs = read_table(spark, sf_dir, "documents")
    index = lines.LineIndex(spark, work_dir(spark, "lines"), min_chars=40).insert_in_parts(docs, 2)
    return index.clean(docs, min_docs=5).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_benchmark_decontamination(spark, sf_dir):
    """Every benchmark passage found in a document."""
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_source_mixing(spark, sf_dir):
    """Rate of every document so that the languages' expected token totals match their targets.
    The domains are the languages: they can be told from a text, which the sources cannot."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").select("doc_id")
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(labels, "doc_id", "left_semi")
    return mixing.document_rates(docs, labelled, {"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15})


def op7_license_scan(spark, sf_dir):
    """Own or inherited licence of every document; its file lies at source/lang/doc_id."""
    docs = read_table(spark, sf_dir, "documents")
    return licenses.licence_scan(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op8_ngram_jaccard_join(spark, sf_dir):
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return similar.similar_components(read_table(spark, sf_dir, "documents"), n=4, percent=85)


def op9_quality_rules(spark, sf_dir):
    """Base counts and the line-first verdict for every document."""
    return rules.quality_rules(read_table(spark, sf_dir, "documents")).drop("clean_text")


def op10_suffix_array_dedup(spark, sf_dir):
    """Bytes in strings of 400 bytes that start more than once go."""
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents"), length=400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"))


def op11_lm_scoring(spark, sf_dir):
    """Log10 probabilities of every document by the hashed maximum-entropy model and by smoothed frequencies."""
    return language.score_documents(read_table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark, sf_dir):
    """16 centroids of all vectors with 64 components, in integers, after three rounds."""
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64, seed=1)


def op13_hard_negatives(spark, sf_dir):
    """For every 50th vector and each of its five positives the three best negatives in its window of scores."""
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), positives=5, negatives=3, low=50, high=95, every=50, scale=256)


QUERIES = {f.__name__: f for f in (op1_warc, op2_token_ids, op3_quality_classifier, op4_line_dedup, op5_benchmark_decontamination,
                                   op6_source_mixing, op7_license_scan, op8_ngram_jaccard_join, op9_quality_rules, op10_suffix_array_dedup,
                                   op11_lm_scoring, op12_centroid_clustering, op13_hard_negatives)}
