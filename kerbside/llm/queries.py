"""Query catalogue of the subpackage: one query per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kerbside.llm.bpe_backtrack import op11_bpe
from kerbside.llm.fuzzy_lines import op10_fuzzy_lines
from kerbside.llm.hard_negatives import SQL as NEGATIVES_SQL
from kerbside.llm.hard_negatives import op13_hard_negatives
from kerbside.llm.langid import op5_language_id
from kerbside.llm.merkle import SQL as MERKLE_SQL
from kerbside.llm.merkle import op12_merkle_manifest
from kerbside.llm.ngram_join import op1_ngram_jaccard_join
from kerbside.llm.quality_model import op3_quality_classifier
from kerbside.llm.robust_rules import op4_quality_rules
from kerbside.llm.ss_packing import op7_packing
from kerbside.llm.stratified_shards import op9_sharding
from kerbside.llm.string_tiling import op6_decontamination
from kerbside.llm.token_index import op2_token_files
from kerbside.llm.url_rules import SQL as URL_SQL
from kerbside.llm.url_rules import op8_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_files": op2_token_files,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_url_filters": op8_url_filters,
    "op9_sharding": op9_sharding,
    "op10_fuzzy_lines": op10_fuzzy_lines,
    "op11_bpe": op11_bpe,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hard_negatives": op13_hard_negatives,
}

#: DuckDB SQL where SQL can state the whole result; the others are held against
#: brute-force versions in tests/llm.
ORACLES: dict[str, str] = {"op8_url_filters": URL_SQL, "op12_merkle_manifest": MERKLE_SQL, "op13_hard_negatives": NEGATIVES_SQL}
