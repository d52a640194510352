"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lexmill.llm import alignment, ballkmeans, decontaminate, katz, packing, passages, quality, quotes, repair, simhash, syncmers, toxicity, warc

QUERIES = {
    "op1_katz_backoff_lm": katz.op1,
    "op2_warc_index": warc.op2,
    "op3_quotation_linking": quotes.op3,
    "op4_token_ids_repair": repair.op4,
    "op5_subword_toxicity": toxicity.op5,
    "op6_best_two_fit_packing": packing.op6,
    "op7_benchmark_decontamination": decontaminate.op7,
    "op8_attention_mil_quality": quality.op8,
    "op9_simhash_near_dedup": simhash.op9,
    "op10_closed_syncmer_fingerprints": syncmers.op10,
    "op11_tokenizer_alignment": alignment.op11,
    "op12_relative_lz_passages": passages.op12,
    "op13_ball_kmeans": ballkmeans.op13,
}

ORACLES = {
    "op2_warc_index": warc.OP2_SQL,
    "op3_quotation_linking": quotes.OP3_SQL,
    "op7_benchmark_decontamination": decontaminate.OP7_SQL,
    "op12_relative_lz_passages": passages.OP12_SQL,
    "op13_ball_kmeans": ballkmeans.OP13_SQL,
}
