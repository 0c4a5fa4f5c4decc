"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ballastry.llm.byte_pairs import op11_byte_pairs
from ballastry.llm.cap_filters import OP10_SQL, op10_cap_filters
from ballastry.llm.decontaminate import OP1_SQL, op1_decontaminate
from ballastry.llm.hilbert_shards import op8_hilbert_shards
from ballastry.llm.html_text import op5_html_text
from ballastry.llm.language_id import op6_language_id
from ballastry.llm.line_dedup import OP7_SQL, op7_line_dedup
from ballastry.llm.ngram_jaccard import OP4_SQL, op4_ngram_jaccard
from ballastry.llm.piece_dropout import op3_piece_dropout
from ballastry.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from ballastry.llm.token_files import op9_token_files
from ballastry.llm.url_reputation import OP2_SQL, op2_url_reputation
from ballastry.llm.whitening import op12_whitening

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_url_reputation": op2_url_reputation,
    "op3_piece_dropout": op3_piece_dropout,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_html_text": op5_html_text,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_hilbert_shards": op8_hilbert_shards,
    "op9_token_files": op9_token_files,
    "op10_cap_filters": op10_cap_filters,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op1_decontaminate": OP1_SQL,
    "op2_url_reputation": OP2_SQL,
    "op4_ngram_jaccard": OP4_SQL,
    "op7_line_dedup": OP7_SQL,
    "op10_cap_filters": OP10_SQL,
    "op13_prefix_trie": OP13_SQL,
}
