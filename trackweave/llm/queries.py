"""One registered query per operator: production parameters, whole tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..lineage import session_folder
from .chat_format import conversation_digests, format_conversations
from .decontaminate import decontamination_report
from .html_extract import main_text
from .jaccard_join import jaccard_components
from .lm_scores import lm_scores
from .merkle import verified_documents
from .pii import personal_data
from .quality_classifier import quality_scores
from .quality_rules import quality_verdicts
from .sentence_pieces import encoded_documents
from .toxicity import toxicity_scores
from .turn_repair import repaired_conversations
from .warc import read_records, write_archives

# The folder of public vocabulary files; ``TOKENIZERS`` names another one.
TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")
PIECE_MODEL = os.path.join(TOKENIZERS, "piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_verdicts(_table(spark, sf_dir, "documents"), ["doc_id"])
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(f"quality.{c}" for c in (*shown, "n_failed", "host_rate")))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(format_conversations(rows.unionByName(probe)))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontamination_report(documents, benchmark)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"), os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(_table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_documents(_table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = os.path.join(session_folder(spark), f"warc-{uuid.uuid4().hex}")
    write_archives(_table(spark, sf_dir, "pages"), folder)
    read = read_records(spark, folder)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


REGISTRY = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_extract": op2_html_extract,
    "op3_chat_format": op3_chat_format,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_sentence_pieces": op5_sentence_pieces,
    "op6_decontamination": op6_decontamination,
    "op7_lm_scores": op7_lm_scores,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
    "op11_turn_repair": op11_turn_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_warc": op13_warc,
}
