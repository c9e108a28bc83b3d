"""The corpus operators' queries, each over its whole table, and the SQL where SQL can express them."""

from __future__ import annotations

from mosaiq.llm import bpe, decontaminate, exact_dedup, html_text, language, sharding, simhash, source_audit, token_file, toxicity, vector_codes, vector_dedup, warc


def queries() -> dict:
    return {
        "op1_fm_decontamination": decontaminate.op1_fm_decontamination,
        "op2_token_file": token_file.op2_token_file,
        "op3_feistel_shards": sharding.op3_feistel_shards,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_simhash_components": simhash.op5_simhash_components,
        "op6_warc_derivatives": warc.op6_warc_derivatives,
        "op7_toxic_passages": toxicity.op7_toxic_passages,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_html_density": html_text.op9_html_density,
        "op10_language_filters": language.op10_language_filters,
        "op11_vector_dedup": vector_dedup.op11_vector_dedup,
        "op12_source_divergence": source_audit.op12_source_divergence,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_fm_decontamination": decontaminate.OP1_SQL, "op4_exact_dedup": exact_dedup.OP4_SQL, "op12_source_divergence": source_audit.OP12_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
