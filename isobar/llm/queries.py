"""Registry of the text operators' queries and of their SQL, where SQL can express them."""

from __future__ import annotations

from .alignment import op13_tokenizer_alignment
from .bpe import op7_byte_bpe
from .chat import OP8_SQL, op8_chat
from .embeddings import op10_embedding_graph
from .htmltext import op6_html_text
from .packing import op5_packing
from .phrases import OP11_SQL, op11_phrases
from .quality import op1_ngram_quality
from .sharding import OP12_SQL, op12_minimax_shards
from .simhash import op3_simhash
from .substrings import op2_suffix_dedup
from .urls import op9_url_filter
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_ngram_quality": op1_ngram_quality,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_html_text": op6_html_text,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_chat": op8_chat,
    "op9_url_filter": op9_url_filter,
    "op10_embedding_graph": op10_embedding_graph,
    "op11_phrases": op11_phrases,
    "op12_minimax_shards": op12_minimax_shards,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE: dict[str, str] = {"op4_warc": OP4_SQL, "op8_chat": OP8_SQL, "op11_phrases": OP11_SQL, "op12_minimax_shards": OP12_SQL}
