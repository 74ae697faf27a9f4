"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, counts, credentials, languages, leaks, lines, neighbours, phrases, repeats, similar, tokens, toxicity, warc

MODULES = {"op1_line_dedup": lines, "op2_hilbert_neighbours": neighbours, "op3_suffix_repeats": repeats, "op4_jaccard_join": similar, "op5_warc_archive": warc, "op6_crf_languages": languages, "op7_bpe_tokens": tokens, "op8_toxicity": toxicity, "op9_benchmark_leaks": leaks, "op10_secret_scan": credentials, "op11_token_counts": counts, "op12_tokenizer_alignment": alignment, "op13_collocations": phrases}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in MODULES.items() if getattr(module, "ORACLE", None)}
