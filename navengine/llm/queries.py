"""The operators' queries, one opN_<name> for each, and SQL where it can express them."""

from __future__ import annotations

from .html_text import op5_html_extraction
from .jaccard_join import op3_ngram_jaccard_join
from .language_id import op1_language_id
from .line_dedup import op9_line_dedup
from .media import op7_media_columns
from .packing import op6_best_fit_packing
from .quality import op10_quality_classifier
from .sentence_pieces import op2_sentence_pieces
from .simhash import op12_simhash_near_dedup
from .spelling import op13_spelling_variants
from .topk_search import OP8_SQL, op8_exact_top_k
from .warc import OP4_SQL, op4_warc
from .whitening import op11_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_sentence_pieces, op3_ngram_jaccard_join, op4_warc, op5_html_extraction, op6_best_fit_packing, op7_media_columns,
        op8_exact_top_k, op9_line_dedup, op10_quality_classifier, op11_embedding_whitening, op12_simhash_near_dedup, op13_spelling_variants,
    )
}

ORACLE_SQL = {"op4_warc": OP4_SQL, "op8_exact_top_k": OP8_SQL}
