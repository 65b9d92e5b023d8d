"""The queries of this subpackage, one op<N>_<name> for each operator N."""

from sedimenta.llm import q01_context_tree, q02_exact_dedup, q03_toxicity, q04_language, q05_packing, q06_parity_join, q07_tiff, q08_mixing, q09_surrogates, q10_chat

MODULES = (q01_context_tree, q02_exact_dedup, q03_toxicity, q04_language, q05_packing, q06_parity_join, q07_tiff, q08_mixing, q09_surrogates, q10_chat)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
