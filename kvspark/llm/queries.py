"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from kvspark.llm.contamination import op7_contamination
from kvspark.llm.jaccard import op2_jaccard
from kvspark.llm.lm import op8_lm
from kvspark.llm.mixing import op4_mix
from kvspark.llm.secrets import op3_secrets
from kvspark.llm.substrings import op6_substrings
from kvspark.llm.tokens import op10_tokens
from kvspark.llm.toxicity import op1_toxicity
from kvspark.llm.vectors import op5_vectors
from kvspark.llm.warc import OP9_SQL, op9_warc


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run, "op1_toxicity": op1_toxicity, "op2_jaccard": op2_jaccard, "op3_secrets": op3_secrets, "op4_mix": op4_mix, "op5_vectors": op5_vectors, "op6_substrings": op6_substrings, "op7_contamination": op7_contamination, "op8_lm": op8_lm, "op9_warc": op9_warc, "op10_tokens": op10_tokens}


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": OP9_SQL}
