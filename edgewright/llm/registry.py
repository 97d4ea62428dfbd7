"""The queries of this folder, by the names under which the entry file registers them."""

from __future__ import annotations

from edgewright.llm import bpe, classlm, langid, licences, linededup, merkle, neardup, packing, pagediff, quality, runs, substrings, winnow

QUERIES = {
    "op1_nearest_page_difference": pagediff.query,
    "op2_super_kmer_substrings": substrings.query,
    "op3_bpe_round_trip": bpe.query,
    "op4_licence_scan": licences.query,
    "op5_rank_order_language": langid.query,
    "op6_minhash_groups": neardup.query,
    "op7_winnowing": winnow.query,
    "op8_linear_grouping_pack": packing.query,
    "op9_risk_controlled_quality": quality.query,
    "op10_class_bigram_score": classlm.query,
    "op11_merkle_manifest": merkle.query,
    "op12_levelled_line_runs": linededup.query,
    "op13_suffix_tree_runs": runs.query,
}
SQL: dict[str, str] = {
    "op4_licence_scan": licences.SQL,
    "op2_super_kmer_substrings": substrings.SQL,
    "op6_minhash_groups": neardup.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_levelled_line_runs": linededup.SQL,
}
