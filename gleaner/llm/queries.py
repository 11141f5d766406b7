"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from gleaner.llm import ann, chat, decontam, fixity, html_main, knn, packing, pq_codes, quality, sharding, simhash, spelling, tokens

QUERIES = {
    "op1_preference_format": chat.op1_preference_format,
    "op2_template_decontam": decontam.op2_template_decontam,
    "op3_byte_cnn_quality": quality.op3_byte_cnn_quality,
    "op4_feistel_shards": sharding.op4_feistel_shards,
    "op5_fst_token_counts": tokens.op5_fst_token_counts,
    "op6_voronoi_topk": knn.op6_voronoi_topk,
    "op7_merkle_fixity": fixity.op7_merkle_fixity,
    "op8_simhash_ball": simhash.op8_simhash_ball,
    "op9_bestfit_packing": packing.op9_bestfit_packing,
    "op10_dom_graphical": html_main.op10_dom_graphical,
    "op11_adaptive_scan": ann.op11_adaptive_scan,
    "op12_delta_lloyd": pq_codes.op12_delta_lloyd,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

#: The other operators need byte hashes, tokenizers, trained models or graph search, which SQL hasn't: their tests use brute force.
ORACLES: dict[str, str] = {"op1_preference_format": chat.OP1_SQL, "op6_voronoi_topk": knn.OP6_SQL, "op7_merkle_fixity": fixity.OP7_SQL, "op12_delta_lloyd": pq_codes.OP12_SQL, "op13_spelling_variants": spelling.OP13_SQL}
