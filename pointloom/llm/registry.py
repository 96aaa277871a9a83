"""Queries of this subpackage, and SQL twins where SQL can express them."""

from __future__ import annotations

from pointloom.llm.balltree import OP9_SQL, op9_top_k
from pointloom.llm.clusters import OP11_SQL, op11_orchard_clusters
from pointloom.llm.fingerprints import op1_fingerprints
from pointloom.llm.hmm import op3_hmm_scores
from pointloom.llm.langid import op2_language_id
from pointloom.llm.licenses import op10_license_scan
from pointloom.llm.licenses import oracle as license_sql
from pointloom.llm.mixing import OP8_SQL, op8_source_mixing
from pointloom.llm.packing import op4_bit_packing
from pointloom.llm.periods import op13_periodic_runs
from pointloom.llm.pieces import op6_sentencepiece
from pointloom.llm.quality import op5_quality_mil
from pointloom.llm.simhash import op7_simhash
from pointloom.llm.toxicity import op12_toxicity

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_language_id": op2_language_id,
    "op3_hmm_scores": op3_hmm_scores,
    "op4_bit_packing": op4_bit_packing,
    "op5_quality_mil": op5_quality_mil,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_simhash": op7_simhash,
    "op8_source_mixing": op8_source_mixing,
    "op9_top_k": op9_top_k,
    "op10_license_scan": op10_license_scan,
    "op11_orchard_clusters": op11_orchard_clusters,
    "op12_toxicity": op12_toxicity,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {"op8_source_mixing": OP8_SQL, "op9_top_k": OP9_SQL, "op10_license_scan": license_sql(), "op11_orchard_clusters": OP11_SQL}
