"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from framegrain.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from framegrain.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from framegrain.llm.html_extract import op10_html_extraction
from framegrain.llm.jaccard_join import OP2_SQL, op2_jaccard_join
from framegrain.llm.license_scan import op12_license_scan
from framegrain.llm.mixing import OP1_SQL, op1_mixing
from framegrain.llm.quality_classifier import op9_quality_classifier
from framegrain.llm.quality_rules import OP5_SQL, op5_quality_rules
from framegrain.llm.sentencepiece import op7_sentencepiece
from framegrain.llm.sharding import OP6_SQL, op6_sharding
from framegrain.llm.suffix_dedup import OP3_SQL, op3_suffix_dedup
from framegrain.llm.toxicity import op8_toxicity
from framegrain.llm.whitening import op11_whitening

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_sharding": op6_sharding,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_toxicity": op8_toxicity,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_html_extraction": op10_html_extraction,
    "op11_whitening": op11_whitening,
    "op12_license_scan": op12_license_scan,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {
    "op1_mixing": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op5_quality_rules": OP5_SQL, "op6_sharding": OP6_SQL,
    "op13_hard_negatives": OP13_SQL,
}
