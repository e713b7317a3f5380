"""Queries of this subpackage by name, and DuckDB SQL where it can express one on whole tables."""

from .classifier import op7_quality_classifier
from .dac import op9_token_ids
from .divergence import op11_source_divergence
from .fim import op12_fill_in_middle
from .jaccard import op6_ngram_jaccard
from .langid import op3_language_id
from .lattice import op13_lattice_scores
from .oracles import ORACLES
from .packing import op1_best_fit_packing
from .pieces import op8_sentencepiece
from .pii import op2_pii_surrogates
from .rules import op10_quality_rules
from .suffix import op5_suffix_dedup
from .vptree import op4_vantage_point_search

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_pii_surrogates, op3_language_id, op4_vantage_point_search, op5_suffix_dedup, op6_ngram_jaccard, op7_quality_classifier, op8_sentencepiece, op9_token_ids, op10_quality_rules, op11_source_divergence, op12_fill_in_middle, op13_lattice_scores)}

__all__ = ["ORACLES", "QUERIES"]
