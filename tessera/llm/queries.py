"""The registered queries of the corpus operators and their DuckDB SQL."""

from tessera.llm import decontam, lines, lm, media, mixing, quality, sharding, simhash, substring, tokenfile

QUERIES = {
    "op1_decontamination": decontam.op1,
    "op2_simhash": simhash.op2,
    "op3_sharding": sharding.op3,
    "op4_media_sequences": media.op4,
    "op5_token_files": tokenfile.op5,
    "op6_quality": quality.op6,
    "op7_lm_scores": lm.op7,
    "op8_substring_dedup": substring.op8,
    "op9_mixing": mixing.op9,
    "op10_line_dedup": lines.op10,
}

ORACLES = {
    "op1_decontamination": decontam.ORACLE,
    "op3_sharding": sharding.ORACLE,
    "op8_substring_dedup": substring.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_line_dedup": lines.ORACLE,
}
