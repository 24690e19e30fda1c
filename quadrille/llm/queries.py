"""Queries of the training-data operators, with SQL where it can express them."""

from . import chat, counts, exact, fim, fingerprints, language, licenses, mixing, neardup, pieces_dropout, quality, toxicity, trie

QUERIES = {
    "op1_spot_signatures": fingerprints.op1,
    "op2_token_counts": counts.op2,
    "op3_chat_formatting": chat.op3,
    "op4_exact_dedup": exact.op4,
    "op5_toxicity": toxicity.op5,
    "op6_piece_dropout": pieces_dropout.op6,
    "op7_language_id": language.op7,
    "op8_near_dedup": neardup.op8,
    "op9_source_mixing": mixing.op9,
    "op10_license_scan": licenses.op10,
    "op11_fill_in_middle": fim.op11,
    "op12_quality": quality.op12,
    "op13_prefix_trie": trie.op13,
}
ORACLES = {"op3_chat_formatting": chat.OP3_SQL, "op4_exact_dedup": exact.OP4_SQL, "op11_fill_in_middle": fim.OP11_SQL, "op13_prefix_trie": trie.OP13_SQL}
