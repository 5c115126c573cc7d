"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpus_pipeline import run as run_pipeline
from turnledger.llm.bagminhash import OP10_SQL, op10_near_dedup
from turnledger.llm.contamination import OP1_SQL, op1_decontamination
from turnledger.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from turnledger.llm.ngram_filter import op9_lm_scoring
from turnledger.llm.phrase_automata import OP5_SQL, op5_substring_dedup
from turnledger.llm.piece_sampling import op8_sentencepiece
from turnledger.llm.pseudonyms import op4_pseudonyms
from turnledger.llm.token_alignment import op12_token_alignment
from turnledger.llm.token_files import op7_token_output
from turnledger.llm.toxicity import op3_toxicity
from turnledger.llm.turn_repair import OP11_SQL, op11_turn_repair
from turnledger.llm.url_filter import OP13_SQL, op13_url_filter
from turnledger.llm.warc import OP2_SQL, op2_warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_output": op7_token_output,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_near_dedup": op10_near_dedup,
    "op11_turn_repair": op11_turn_repair,
    "op12_token_alignment": op12_token_alignment,
    "op13_url_filter": op13_url_filter,
    "pipeline": run_pipeline,
}

SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op10_near_dedup": OP10_SQL,
    "op11_turn_repair": OP11_SQL,
    "op13_url_filter": OP13_SQL,
}
