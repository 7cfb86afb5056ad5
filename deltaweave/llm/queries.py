"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from deltaweave.llm.chat_format import OP6_SQL, op6_chat_format
from deltaweave.llm.harmonic_packing import op10_harmonic_packing
from deltaweave.llm.kdtree_topk import OP1_SQL, op1_kdtree_topk
from deltaweave.llm.langid_crf import op9_langid_crf
from deltaweave.llm.mixing import op7_mixing
from deltaweave.llm.ngram_jaccard import OP2_SQL, op2_ngram_jaccard
from deltaweave.llm.pii_semicrf import op5_pii_semicrf
from deltaweave.llm.toxicity_wfst import op4_toxicity_wfst
from deltaweave.llm.url_templates import OP3_SQL, op3_url_templates
from deltaweave.llm.webp_lossless import op8_webp_lossless

QUERIES = {
    "op1_kdtree_topk": op1_kdtree_topk,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_url_templates": op3_url_templates,
    "op4_toxicity_wfst": op4_toxicity_wfst,
    "op5_pii_semicrf": op5_pii_semicrf,
    "op6_chat_format": op6_chat_format,
    "op7_mixing": op7_mixing,
    "op8_webp_lossless": op8_webp_lossless,
    "op9_langid_crf": op9_langid_crf,
    "op10_harmonic_packing": op10_harmonic_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_kdtree_topk": OP1_SQL,
    "op2_ngram_jaccard": OP2_SQL,
    "op3_url_templates": OP3_SQL,
    "op6_chat_format": OP6_SQL,
}
