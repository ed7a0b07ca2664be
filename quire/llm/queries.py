"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.bpe import op10_bpe
from quire.llm.fingerprint import op6_fingerprints
from quire.llm.hnsw import op5_hnsw
from quire.llm.licences import op1_licences
from quire.llm.linededup import op12_lines
from quire.llm.mixing import op2_mixing
from quire.llm.neardup import op4_minhash
from quire.llm.oracles import CODES, LICENCES, LINES, NEAR_DUPLICATES, PREFIXES, REPEATS
from quire.llm.prefixtrie import op13_prefixes
from quire.llm.quality import op3_quality
from quire.llm.repeats import op9_repeats
from quire.llm.tokencount import op7_tokens
from quire.llm.toxicity import op8_toxicity
from quire.llm.vectorcodes import op11_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_licences": op1_licences, "op2_mixing": op2_mixing, "op3_quality": op3_quality, "op4_minhash": op4_minhash, "op5_hnsw": op5_hnsw, "op6_fingerprints": op6_fingerprints, "op7_tokens": op7_tokens, "op8_toxicity": op8_toxicity, "op9_repeats": op9_repeats, "op10_bpe": op10_bpe, "op11_codes": op11_codes, "op12_lines": op12_lines, "op13_prefixes": op13_prefixes}


def oracle_sql() -> dict[str, str]:
    return {"op1_licences": LICENCES, "op4_minhash": NEAR_DUPLICATES, "op9_repeats": REPEATS, "op11_codes": CODES, "op12_lines": LINES, "op13_prefixes": PREFIXES}
