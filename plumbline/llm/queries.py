"""Queries of this folder's operators and the SQL that they are checked against; None where SQL cannot express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import compress_quality, dialogue, exact_index, html_text, license_scan, mixing, odd_minhash, packing, passages, scaled_sketch, token_store, vector_graph, whitening

CHECKS = {
    "op1_html": (html_text.op1_html, None),
    "op2_licenses": (license_scan.op2_licenses, license_scan.SQL),
    "op3_vectors": (vector_graph.op3_vectors, vector_graph.SQL),
    "op4_quality": (compress_quality.op4_quality, None),
    "op5_mix": (mixing.op5_mix, mixing.SQL),
    "op6_exact": (exact_index.op6_exact, exact_index.SQL),
    "op7_token_store": (token_store.op7_token_store, None),
    "op8_near": (odd_minhash.op8_near, None),
    "op9_passages": (passages.op9_passages, None),
    "op10_pack": (packing.op10_pack, None),
    "op11_fingerprint": (scaled_sketch.op11_fingerprint, scaled_sketch.SQL),
    "op12_dialogue": (dialogue.op12_dialogue, dialogue.SQL),
    "op13_whitening": (whitening.op13_whitening, None),
}
