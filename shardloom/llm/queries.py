"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from shardloom.llm import ann, chat, jaccard, leaks, licenses, lines, middle, mixing, pieces, repeats, resample, subspace, toxicity

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_licenses": licenses.op2_licenses,
    "op3_ann": ann.op3_ann,
    "op4_mixing": mixing.op4_mixing,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pieces": pieces.op7_pieces,
    "op8_lines": lines.op8_lines,
    "op9_subspace": subspace.op9_subspace,
    "op10_repeats": repeats.op10_repeats,
    "op11_middle": middle.op11_middle,
    "op12_resample": resample.op12_resample,
    "op13_leaks": leaks.op13_leaks,
}
ORACLES = {"op1_chat": chat.OP1_SQL, "op2_licenses": licenses.OP2_SQL, "op11_middle": middle.OP11_SQL, "op13_leaks": leaks.OP13_SQL}
