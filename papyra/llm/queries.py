"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from papyra.llm.block_names import OP13_SQL, op13_block_names
from papyra.llm.context_mix import op7_context_mix
from papyra.llm.elkan import OP12_SQL, op12_elkan
from papyra.llm.filter_audit import OP11_SQL, op11_filter_audit
from papyra.llm.fingerprint import op1_fingerprint
from papyra.llm.ngram_join import op4_ngram_join
from papyra.llm.piece_encode import op3_sentencepiece
from papyra.llm.quality import op2_quality
from papyra.llm.source_mix import OP5_SQL, op5_source_mix
from papyra.llm.token_counts import op8_token_counts
from papyra.llm.url_rules import OP6_SQL, op6_url_filter
from papyra.llm.vector_join import op9_vector_join
from papyra.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_quality": op2_quality,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_ngram_join": op4_ngram_join,
    "op5_source_mix": op5_source_mix,
    "op6_url_filter": op6_url_filter,
    "op7_context_mix": op7_context_mix,
    "op8_token_counts": op8_token_counts,
    "op9_vector_join": op9_vector_join,
    "op10_warc": op10_warc,
    "op11_filter_audit": op11_filter_audit,
    "op12_elkan": op12_elkan,
    "op13_block_names": op13_block_names,
}
ORACLE_SQL = {
    "op5_source_mix": OP5_SQL,
    "op6_url_filter": OP6_SQL,
    "op10_warc": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_elkan": OP12_SQL,
    "op13_block_names": OP13_SQL,
}
