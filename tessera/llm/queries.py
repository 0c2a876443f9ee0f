"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audio, language_id, language_model, mixing, near_dedup, packing, secrets, spotsigs, token_rollup, toxicity


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_token_rollup": token_rollup.op2_token_rollup,
        "op3_pack_sequences": packing.op3_pack_sequences,
        "op4_near_duplicates": near_dedup.op4_near_duplicates,
        "op5_spot_signatures": spotsigs.op5_spot_signatures,
        "op6_secret_scan": secrets.op6_secret_scan,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_language_model": language_model.op8_language_model,
        "op9_chroma_fingerprints": audio.op9_chroma_fingerprints,
        "op10_mix_sources": mixing.op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_token_rollup": token_rollup.ORACLE, "op10_mix_sources": mixing.ORACLE}
