"""The registered queries of the training-data operators."""

from __future__ import annotations

from corpuskit.llm import consensus, lookalike, mixing, mojibake, ranking, residue, sentences, splits, tokens

QUERIES = {
    "p1_found": splits.p1_found,
    "p1_splits": splits.p1_splits,
    "p2_found": mojibake.p2_found,
    "p2_restored": mojibake.p2_restored,
    "p2_rules": mojibake.p2_rules,
    "p4_found": sentences.p4_found,
    "p4_sentences": sentences.p4_sentences,
    "p5_found": consensus.p5_found,
    "p5_annotators": consensus.p5_annotators,
    "p5_consensus": consensus.p5_consensus,
    "p5_agreement": consensus.p5_agreement,
    "p6_found": lookalike.p6_found,
    "p6_classes": lookalike.p6_classes,
    "p6_normalised": lookalike.p6_normalised,
    "p7_found": ranking.p7_found,
    "p7_ranking": ranking.p7_ranking,
    "p8_ids": tokens.p8_ids,
    "p8_roundtrip": tokens.p8_roundtrip,
    "p9_selection": mixing.p9_selection,
    "p9_shares": mixing.p9_shares,
    "p9_rounds": mixing.p9_rounds,
    "p9_classifier": mixing.p9_classifier,
    "p10_found": residue.p10_found,
    "p10_kept": residue.p10_kept,
    "p10_kinds": residue.p10_kinds,
}
