"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glimmer.llm.bpe import op2_bpe
from glimmer.llm.chat import op1_chat_format
from glimmer.llm.chunks import op7_fingerprints
from glimmer.llm.embed import op9_embedding_dedup
from glimmer.llm.licenses import ORACLE_SQL as LICENSES_SQL
from glimmer.llm.licenses import op10_licenses
from glimmer.llm.lm import op3_lm_scores
from glimmer.llm.minhash import op6_minhash
from glimmer.llm.packing import op8_packing
from glimmer.llm.pii import op13_pii
from glimmer.llm.quality import op4_quality
from glimmer.llm.toxicity import op5_toxicity
from glimmer.llm.variants import op11_spelling_variants
from glimmer.llm.whiten import op12_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_format, op2_bpe, op3_lm_scores, op4_quality, op5_toxicity, op6_minhash, op7_fingerprints, op8_packing, op9_embedding_dedup, op10_licenses, op11_spelling_variants, op12_whitening, op13_pii)}

ORACLE_SQL: dict[str, str] = {"op10_licenses": LICENSES_SQL}
