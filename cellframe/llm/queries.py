"""One query for each operator, with production parameters over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from cellframe.llm import chat, decontaminate, licenses, minhash, pii, quality, secrets, sentencepieces, simple8b, toxicity
from cellframe.llm._text import read


def op1_chat_formatting(spark, sf_dir):
    return chat.format_conversations(read(spark, sf_dir, "conversations"))


def op2_simple8b_token_ids(spark, sf_dir):
    return simple8b.encode(read(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    return pii.scan(read(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_secret_scan(spark, sf_dir):
    return secrets.scan(read(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_quality_lines(spark, sf_dir):
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_sentencepiece(spark, sf_dir):
    return sentencepieces.encode(read(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_simple8b_token_ids, op3_license_scan, op4_pii, op5_toxicity, op6_secret_scan, op7_minhash_near_dedup, op8_quality_lines, op9_sentencepiece, op10_decontamination)
}

SQL: dict[str, str] = {}
