"""The queries of this part, and their SQL where SQL can state them."""

from __future__ import annotations

import corpus_pipeline
from webdrift.llm.decontamination import op10_decontamination
from webdrift.llm.hard_negatives import ORACLE as HARD_NEGATIVES_SQL
from webdrift.llm.hard_negatives import op11_hard_negatives
from webdrift.llm.jaccard_join import op2_jaccard_join
from webdrift.llm.language_id import op6_language_id
from webdrift.llm.lexical_search import ORACLE as LEXICAL_SEARCH_SQL
from webdrift.llm.lexical_search import op13_lexical_search
from webdrift.llm.mixing import op8_mixing
from webdrift.llm.packing import op12_packing
from webdrift.llm.pii import op5_pii
from webdrift.llm.quality_classifier import op3_quality_classifier
from webdrift.llm.quality_rules import op4_quality_rules
from webdrift.llm.sharding import op1_sharding
from webdrift.llm.suffix_dedup import op9_suffix_dedup
from webdrift.llm.token_counts import op7_token_counts

QUERIES = {
    "op1_sharding": op1_sharding,
    "op8_mixing": op8_mixing,
    "op2_jaccard_join": op2_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op3_quality_classifier": op3_quality_classifier,
    "op5_pii": op5_pii,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_packing": op12_packing,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op11_hard_negatives": HARD_NEGATIVES_SQL, "op13_lexical_search": LEXICAL_SEARCH_SQL}
