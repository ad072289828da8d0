"""The subpackage's queries, by the names that __spark_entry__.py registers, and their DuckDB statements."""

from __future__ import annotations

from storyloom.llm.bpe_chunks import op5_bpe_chunk_reuse
from storyloom.llm.fingerprints import op4_document_fingerprints
from storyloom.llm.host_rules import OP3_SQL, op3_host_rules
from storyloom.llm.language_id import op9_language_id
from storyloom.llm.mincut_html import op1_mincut_html
from storyloom.llm.piece_bpe import op12_sentencepiece_backtracking
from storyloom.llm.poisson_mix import OP2_SQL, op2_poisson_mix
from storyloom.llm.quality_trees import op7_quality_classifier
from storyloom.llm.quote_links import OP8_SQL, op8_quote_links
from storyloom.llm.simhash_dedup import op10_simhash_near_dedup
from storyloom.llm.source_divergence import OP11_SQL, op11_source_divergence
from storyloom.llm.substring_dedup import op6_substring_dedup
from storyloom.llm.turn_repair import OP13_SQL, op13_conversation_repair

QUERIES = {
    "op1_mincut_html": op1_mincut_html,
    "op2_poisson_mix": op2_poisson_mix,
    "op3_host_rules": op3_host_rules,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_bpe_chunk_reuse": op5_bpe_chunk_reuse,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quote_links": op8_quote_links,
    "op9_language_id": op9_language_id,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_sentencepiece_backtracking": op12_sentencepiece_backtracking,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {"op2_poisson_mix": OP2_SQL, "op3_host_rules": OP3_SQL, "op8_quote_links": OP8_SQL, "op11_source_divergence": OP11_SQL, "op13_conversation_repair": OP13_SQL}
