"""The operators' queries, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe_lexicon, exact_dedup, line_dedup, mixing, near_dup, neural_lm, quality, sketches, token_files, warc
from cairn.llm.common import read


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of pages, from archives written of it and read back. A null html is empty and a response; rows that repeat are captures of their own; a null page_id comes back null. An empty table gives an empty result."""
    return warc.page_report(read(spark, sf_dir, "pages"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents. A null text has size 0; a null source is one, the last; rows that repeat are documents of their own; without words all is 0. An empty table gives an empty result."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents. Null and empty texts get the bias's score; a null id is not held out; of labels that disagree the larger counts. An empty table gives an empty result."""
    return quality.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents, from files written of it and read back. A null text is empty; a null id comes first; rows that repeat an id follow each other. An empty table gives an empty result."""
    return token_files.token_digests(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents. A null text is empty; rows that repeat an id follow each other by text; a null id is the smallest; one row alone is next to itself. An empty table gives an empty result."""
    return sketches.edit_report(read(spark, sf_dir, "documents"))


def op6_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents. A null text is empty and has no ids; special tokens within a text get their ids. An empty table gives an empty result."""
    return bpe_lexicon.encode_digests(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents. Null and empty texts have fingerprint 0; a null id takes part, but names no component that has another. An empty table gives an empty result."""
    groups = near_dup.near_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents. A null text is empty; a null id is smaller than any; of rows that repeat id and text one is kept. An empty table gives an empty result."""
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op9_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents. A null text is empty: its one token is its end; a null id is not held out; rows that repeat are texts of their own. An empty table gives an empty result."""
    return neural_lm.lm_scores(read(spark, sf_dir, "documents"))


def op10_line_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents. Null and empty texts have one empty line; rows that repeat an id count as one document; a null id is smaller than any. An empty table gives an empty result."""
    kept = line_dedup.drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op2: sizes and targets."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op5: lengths and edited texts."""
    return sketches.edit_report(read(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {
    f.__name__: f
    for f in (op1_warc_captures, op2_source_mix, op3_ftrl_quality, op4_token_files, op5_scaled_sketch, op6_bpe_lexicon, op7_gray_index, op8_chunk_recipes, op9_neural_lm, op10_line_hash, mix_targets, edited_texts)
}
ORACLES = {"op1_warc_captures": warc.ORACLE, "op8_chunk_recipes": exact_dedup.ORACLE, "op10_line_hash": line_dedup.ORACLE, "mix_targets": mixing.TARGETS, "edited_texts": sketches.EDITED}
