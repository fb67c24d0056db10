"""The operators as registered queries, with the parameters of production, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import arc, chosen_path, gam, hyperdim, length_buckets, line_index, ns_kmeans, ppm, prefix_trie, quotient, templates, url_terms, wrappers
from .common import read, remainder

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arc.convert_pages(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read(spark, sf_dir, "documents", "doc_id", "text"), remainder("doc_id", 7) == 2)


def op4_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_quotient_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient.exact_groups(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_terms.judge(read(spark, sf_dir, "pages", "page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "weight")


def op7_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    rows = hyperdim.identify(docs, remainder("doc_id", 4) != 2)
    return rows.select("doc_id", (~F.col("learnt")).alias("held_out"), "lang_pred", "score")


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets.pack(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_components(read(spark, sf_dir, "documents", "doc_id", "text"), width=4)


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels", "doc_id", "quality").withColumnRenamed("quality", "label")
    return gam.quality(read(spark, sf_dir, "documents", "doc_id", "text"), labels, remainder("doc_id", 4) == 2)


def op11_ns_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ns_kmeans.clustered(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_index.line_dedup(read(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_template_leaks, op2_arc_to_warc, op3_ppm_score, op4_wrapper_text, op5_quotient_dedup, op6_url_vocabulary,
                            op7_hyperdimensional_language, op8_length_buckets, op9_chosen_path, op10_quality_gam, op11_ns_kmeans, op12_prefix_trie, op13_line_index)
}
