"""The queries of this folder and, where SQL can state them, the same for DuckDB."""

from __future__ import annotations

from . import clustering, embeddings, jaccard, langid, lines, lm, media, mixing, packing, repeats, resampling, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_query,
    "op2_line_dedup": lines.op2_query,
    "op3_lm_scoring": lm.op3_query,
    "op4_mix_sources": mixing.op4_query,
    "op5_language_id": langid.op5_query,
    "op6_jaccard_join": jaccard.op6_query,
    "op7_best_fit_packing": packing.op7_query,
    "op8_embedding_near_dedup": embeddings.op8_query,
    "op9_media_columns": media.op9_query,
    "op10_suffix_dedup": repeats.op10_query,
    "op11_centroid_clustering": clustering.op11_query,
    "op12_toxicity": toxicity.op12_query,
    "op13_importance_resampling": resampling.op13_query,
}

SQL = {
    "op1_warc": warc.OP1_SQL,
    "op2_line_dedup": lines.OP2_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
    "op6_jaccard_join": jaccard.OP6_SQL,
    "op8_embedding_near_dedup": embeddings.OP8_SQL,
    "op10_suffix_dedup": repeats.OP10_SQL,
    "op11_centroid_clustering": clustering.OP11_SQL,
    "op13_importance_resampling": resampling.OP13_SQL,
}
