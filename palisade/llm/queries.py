"""Queries over the operators of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from palisade.llm import bpe, centroids, chat, embeddings, exact_dedup, lines, minhash, mixing, pii, quality, runs, secrets, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_embedding_near_dedup": embeddings.query,
    "op3_chat_format": chat.query,
    "op4_byte_bpe": bpe.query,
    "op5_toxicity": toxicity.query,
    "op6_mixing": mixing.query,
    "op7_secret_scan": secrets.query,
    "op8_minhash_near_dedup": minhash.query,
    "op9_line_dedup": lines.query,
    "op10_pii": pii.query,
    "op11_quality_mil": quality.query,
    "op12_periodic_runs": runs.query,
    "op13_centroid_clusters": centroids.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_embedding_near_dedup": embeddings.SQL,
    "op3_chat_format": chat.SQL,
    "op6_mixing": mixing.SQL,
    "op8_minhash_near_dedup": minhash.SQL,
    "op9_line_dedup": lines.SQL,
    "op12_periodic_runs": runs.SQL,
    "op13_centroid_clusters": centroids.SQL,
}
