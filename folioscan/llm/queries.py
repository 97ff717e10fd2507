"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from folioscan.llm import chains, decontaminate, infill, latticelm, minhash, mixing, prefixtrie, quality, secretscan, substrings, surrogates, tokenfile, tokens

QUERIES = {
    "op1_token_files": tokenfile.op1_token_files,
    "op2_repeated_substrings": substrings.op2_repeated_substrings,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_minhash_near_duplicates": minhash.op5_minhash_near_duplicates,
    "op6_surrogates": surrogates.op6_surrogates,
    "op7_benchmark_leaks": decontaminate.op7_benchmark_leaks,
    "op8_fuzzy_repeats": chains.op8_fuzzy_repeats,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_lattice_scores": latticelm.op10_lattice_scores,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_secret_scans": secretscan.op12_secret_scans,
    "op13_conversation_trie": prefixtrie.op13_conversation_trie,
    "quality_ablations": quality.quality_ablations,
}
ORACLES = {
    "op3_quality_rules": quality.OP3_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op11_fill_in_middle": infill.OP11_SQL,
    "op12_secret_scans": secretscan.OP12_SQL,
    "op13_conversation_trie": prefixtrie.OP13_SQL,
    "quality_ablations": quality.ABLATIONS_SQL,
}
