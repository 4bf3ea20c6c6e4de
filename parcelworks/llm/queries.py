"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelworks.llm import flatgraph, language, licenses, lm, merkle, neardup, packing, phrases, pieces, pii, quality, topk, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_spans": pii.query,
    "op2_lm_scoring": lm.query,
    "op3_minhash_neardup": neardup.query,
    "op4_url_filter": urls.query,
    "op5_license_scan": licenses.query,
    "op6_exact_topk": topk.query,
    "op7_sentencepiece": pieces.query,
    "op8_length_packing": packing.query,
    "op9_quality_rules": quality.query,
    "op10_language_id": language.query,
    "op11_merkle_manifest": merkle.query,
    "op12_phrase_mining": phrases.query,
    "op13_embedding_neardup": flatgraph.query,
}
ORACLES: dict[str, str] = {"op6_exact_topk": topk.SQL, "op11_merkle_manifest": merkle.SQL, "op12_phrase_mining": phrases.SQL, "op13_embedding_neardup": flatgraph.SQL}
