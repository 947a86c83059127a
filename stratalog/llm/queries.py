"""The registered queries of these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from stratalog.llm import (
    alignment,
    bitplanes,
    bpe,
    centroids,
    exact_dedup,
    minhash,
    packing,
    quality,
    sharding,
    simhash,
    token_counts,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_sharding": sharding.op4_sharding,
    "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_bpe_encoding": bpe.op8_bpe_encoding,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_simhash": simhash.op10_simhash,
    "op11_bit_planes": bitplanes.op11_bit_planes,
    "op12_centroid_clustering": centroids.op12_centroid_clustering,
    "op13_alignment": alignment.op13_alignment,
}
SQL = {
    **exact_dedup.SQL,
    **url_filter.SQL,
    **centroids.SQL,
}
