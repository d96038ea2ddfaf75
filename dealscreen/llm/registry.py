"""Queries of the numbered operators and the SQL that restates them."""

from __future__ import annotations

from dealscreen.llm.byte_bpe import op12_byte_bpe
from dealscreen.llm.decontaminate import OP10_SQL, op10_decontaminate
from dealscreen.llm.html import op5_html
from dealscreen.llm.merkle import OP11_SQL, op11_manifest
from dealscreen.llm.mixing import op9_mixing
from dealscreen.llm.negatives import OP13_SQL, op13_negatives
from dealscreen.llm.pieces import op6_pieces
from dealscreen.llm.pii import op1_pii
from dealscreen.llm.quality import op2_quality
from dealscreen.llm.simhash import op3_simhash
from dealscreen.llm.substrings import OP4_SQL, op4_substrings
from dealscreen.llm.suffixes import op8_suffixes
from dealscreen.llm.training_order import op7_training_order

QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_substrings": op4_substrings,
    "op5_html": op5_html,
    "op6_pieces": op6_pieces,
    "op7_training_order": op7_training_order,
    "op8_suffixes": op8_suffixes,
    "op9_mixing": op9_mixing,
    "op10_decontaminate": op10_decontaminate,
    "op11_manifest": op11_manifest,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_negatives": op13_negatives,
}

ORACLES = {"op4_substrings": OP4_SQL, "op10_decontaminate": OP10_SQL, "op11_manifest": OP11_SQL,
           "op13_negatives": OP13_SQL}
