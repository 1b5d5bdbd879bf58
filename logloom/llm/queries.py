"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from logloom.llm import decontamination, fill_in_middle, hmm, language, lexical, line_dedup, mixing, neighbours, pii, quality, simhash, toxicity, warc

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_language_id": language.op2_language_id,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_quality": quality.op4_quality,
    "op5_nn_descent": neighbours.op5_nn_descent,
    "op6_warc_in_zip": warc.op6_warc_in_zip,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_line_templates": line_dedup.op8_line_templates,
    "op9_hmm_scoring": hmm.op9_hmm_scoring,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_pii": pii.op12_pii,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

ORACLES = {
    "op3_decontamination": decontamination.SQL,
    "op6_warc_in_zip": warc.SQL,
    "op8_line_templates": line_dedup.SQL,
    "op10_mix_sources": mixing.SQL,
    "op11_lexical_search": lexical.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
