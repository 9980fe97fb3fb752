"""Queries of this subpackage and the SQL for those that SQL can express."""

from . import align, bpe, brownlm, decontam, htmltext, langid, linededup, media, merkle, neardup, pii, sharding, tokenfile

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_lm_scoring": brownlm.op2_lm_scoring,
    "op3_bpe": bpe.op3_bpe,
    "op4_media": media.op4_media,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_html_text": htmltext.op6_html_text,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_pii": pii.op8_pii,
    "op9_sharding": sharding.op9_sharding,
    "op10_near_dedup": neardup.op10_near_dedup,
    "op11_token_files": tokenfile.op11_token_files,
    "op12_manifest": merkle.op12_manifest,
    "op13_alignment": align.op13_alignment,
}
ORACLES = {
    "op5_line_dedup": linededup.ORACLE,
    "op9_sharding": sharding.ORACLE,
    "op12_manifest": merkle.ORACLE,
}
