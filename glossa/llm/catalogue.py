"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from glossa.llm.op10_toxicity import op10_toxicity
from glossa.llm.op11_whitening import op11_whitening
from glossa.llm.op12_codes import op12_vector_codes
from glossa.llm.op13_counts import op13_token_counts
from glossa.llm.op1_ngrams import op1_ngram_join
from glossa.llm.op2_tokens import op2_token_files
from glossa.llm.op3_windows import op3_repeated_windows
from glossa.llm.op4_substrings import op4_earlier_substrings
from glossa.llm.op5_lines import OP5_SQL, op5_site_lines
from glossa.llm.op6_packing import op6_best_fit_packing
from glossa.llm.op7_search import OP7_SQL, op7_bm25_search
from glossa.llm.op8_quality import op8_quality_rules
from glossa.llm.op9_mixing import op9_mix_sources

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_token_files": op2_token_files,
    "op3_repeated_windows": op3_repeated_windows,
    "op4_earlier_substrings": op4_earlier_substrings,
    "op5_site_lines": op5_site_lines,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_bm25_search": op7_bm25_search,
    "op8_quality_rules": op8_quality_rules,
    "op9_mix_sources": op9_mix_sources,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_counts": op13_token_counts,
}

SQL: dict[str, str] = {
    "op5_site_lines": OP5_SQL,
    "op7_bm25_search": OP7_SQL,
}
