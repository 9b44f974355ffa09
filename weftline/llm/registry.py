"""The queries of this package and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import audio, exact_dedup, language_id, line_dedup, lm, mixing, near_dedup, packing, secrets, toxicity

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_packing": packing.op2_packing,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_audio": audio.op6_audio,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": language_id.op8_language_id,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_lm": lm.op10_lm,
}

ORACLES = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
}
