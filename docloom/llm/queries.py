"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, fingerprints, jaccard, knn, langid, mixing, packing, rules, secrets, sharding
from .common import table

QUERIES = {
    "op1_chat_formatting": lambda spark, d: chat.format_chats(table(spark, d, "conversations")),
    "op2_mix_sources": lambda spark, d: mixing.mixed_ids(table(spark, d, "documents")),
    "op3_packing": lambda spark, d: packing.pack_documents(table(spark, d, "documents")),
    "op4_sharding": lambda spark, d: sharding.shard_documents(table(spark, d, "documents")),
    "op5_quality_rules": lambda spark, d: rules.kept_ids(table(spark, d, "documents")),
    "op6_ngram_jaccard_join": lambda spark, d: jaccard.near_duplicates(table(spark, d, "documents")),
    "op7_secret_scans": lambda spark, d: secrets.find_secrets(table(spark, d, "documents")),
    "op8_document_fingerprints": lambda spark, d: fingerprints.fingerprints_compared(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op9_quality_classifier": lambda spark, d: knn.kept_scores(table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_language_id": lambda spark, d: langid.identify_languages(table(spark, d, "documents")),
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op1_chat_formatting": chat.SQL,
    "op2_mix_sources": mixing.SQL,
    "op4_sharding": sharding.SQL,
    "op5_quality_rules": rules.SQL,
}
