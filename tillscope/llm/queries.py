"""The operators' registered queries and their DuckDB oracles."""

from __future__ import annotations

from tillscope.llm import (cooccur_sanitise, fm_decontam, host_reputation, label_shards, mix_tree, piece_codec, scaled_sketch,
                           secret_links, simhash_planes, simplex_kmeans, turn_repair, unigram_langid, wrapper_extract)

QUERIES = {
    "op1_fm_decontamination": fm_decontam.op1_fm_decontamination,
    "op2_secret_links": secret_links.op2_secret_links,
    "op3_host_reputation": host_reputation.op3_host_reputation,
    "op4_wrapper_extract": wrapper_extract.op4_wrapper_extract,
    "op5_cooccur_sanitise": cooccur_sanitise.op5_cooccur_sanitise,
    "op6_simhash_components": simhash_planes.op6_simhash_components,
    "op7_unigram_langid": unigram_langid.op7_unigram_langid,
    "op8_mix_tree": mix_tree.op8_mix_tree,
    "op9_scaled_sketch": scaled_sketch.op9_scaled_sketch,
    "op10_label_shards": label_shards.op10_label_shards,
    "op11_simplex_kmeans": simplex_kmeans.op11_simplex_kmeans,
    "op12_turn_repair": turn_repair.op12_turn_repair,
    "op13_piece_codec": piece_codec.op13_piece_codec,
}
ORACLE = {
    "op1_fm_decontamination": fm_decontam.ORACLE,
    "op2_secret_links": secret_links.ORACLE,
    "op3_host_reputation": host_reputation.ORACLE,
    "op11_simplex_kmeans": simplex_kmeans.ORACLE,
}
