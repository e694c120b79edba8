"""The registered queries of the subpackage and their SQL; each runs over its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from vitrine.llm.bpe import bpe_encode
from vitrine.llm.exact_dedup import exact_dedup
from vitrine.llm.html_text import extract_main_text, fit_labeller
from vitrine.llm.labelled import held_out
from vitrine.llm.mixing import curriculum
from vitrine.llm.neighbours import nearest
from vitrine.llm.ngram_join import ngram_components
from vitrine.llm.pieces import piece_encode
from vitrine.llm.quality import fit_quality, quality_scores
from vitrine.llm.quotations import reply_order
from vitrine.llm.spelling import spelling_forms
from vitrine.llm.substring_dedup import substring_dedup
from vitrine.llm.tables import read
from vitrine.llm.toxicity import fit_toxicity, toxicity_scores
from vitrine.llm.turn_trie import turn_trie


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents less those of 13-word windows that an earlier document has."""
    kept = substring_dedup(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of 0.85 or more between sets of four-word shingles of all documents."""
    return ngram_components(read(spark, sf_dir, "documents"), width=4, percent=85)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(spark, sf_dir, "pages")
    texts = extract_main_text(pages, fit_labeller(pages), ["page_id", "url"])
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, then the bytes of the ids; both as digests."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe_encode(read(spark, sf_dir, "documents"), path, pattern, ["doc_id"], packed=True, decoded="decoded")
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    found = nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of all conversations without quotations, with what it replies to."""
    return reply_order(read(spark, sf_dir, "conversations"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 3, 1, 2 in turn, 150% of all words, at most two passes over a source."""
    mixed = curriculum(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all documents; the largest id of each group stays."""
    return exact_dedup(read(spark, sf_dir, "documents"), digest="text_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; fold 2 of 4 is never learned from."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, ~held_out("doc_id", 4, 2))
    rows = docs.select("doc_id", "text", held_out("doc_id", 4, 2).alias("held_out"))
    return toxicity_scores(rows, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; fold 1 of 3 is never learned from."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, ~held_out("doc_id", 3, 1))
    rows = docs.select("doc_id", "text", held_out("doc_id", 3, 1).alias("held_out"))
    return quality_scores(rows, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, with near words and the common form that each is a variant of."""
    return spelling_forms(read(spark, sf_dir, "documents"), every=199)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text of the ids, both as digests; ``agrees`` is the library's word on both."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = piece_encode(read(spark, sf_dir, "documents"), path, ["doc_id"], decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees",
    )


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations, with totals of its subtree."""
    return turn_trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_main_text": op3_main_text,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_nearest": op5_nearest,
    "op6_quotation_links": op6_quotation_links,
    "op7_mix_sources": op7_mix_sources,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_spelling_forms": op11_spelling_forms,
    "op12_pieces": op12_pieces,
    "op13_turn_trie": op13_turn_trie,
}
