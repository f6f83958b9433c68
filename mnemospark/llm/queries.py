"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from mnemospark.llm import decontaminate, divergence, jaccard, middle, mixing, pii, quality, secrets, sharding, spots, suffixes, toxicity, warc


def queries() -> dict:
    return {
        "op1_jaccard": jaccard.op1,
        "op2_pii": pii.op2,
        "op3_mix": mixing.op3,
        "op4_shard": sharding.op4,
        "op5_suffix_array": suffixes.op5,
        "op6_secrets": secrets.op6,
        "op7_decontaminate": decontaminate.op7,
        "op8_warc": warc.op8,
        "op9_quality": quality.op9,
        "op10_toxicity": toxicity.op10,
        "op11_divergence": divergence.op11,
        "op12_middle": middle.op12,
        "op13_spotsigs": spots.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": warc.SQL, "op11_divergence": divergence.SQL, "op12_middle": middle.SQL}
