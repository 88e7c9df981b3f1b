"""Registered queries of the operators and their DuckDB twins (where SQL can express them)."""

from __future__ import annotations

from refinespark.llm import oracles
from refinespark.llm.decontaminate import op1_decontaminate
from refinespark.llm.jaccard import ORACLE_SQL as JACCARD_SQL, op11_ngram_jaccard
from refinespark.llm.merkle import ORACLE_SQL as MERKLE_SQL, op13_merkle_manifest
from refinespark.llm.periodic import op12_periodic_runs
from refinespark.llm.pieces import op8_sentencepiece_sampling
from refinespark.llm.quality import op7_quality_rules
from refinespark.llm.secrets import op9_secret_scan
from refinespark.llm.simhash import op4_simhash_groups
from refinespark.llm.substrings import op2_substring_dedup
from refinespark.llm.token_files import op6_token_files
from refinespark.llm.toxicity import op10_toxicity
from refinespark.llm.url_filter import op5_url_filter
from refinespark.llm.warc import op3_warc_archives

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc_archives": op3_warc_archives,
    "op4_simhash_groups": op4_simhash_groups,
    "op5_url_filter": op5_url_filter,
    "op6_token_files": op6_token_files,
    "op7_quality_rules": op7_quality_rules,
    "op8_sentencepiece_sampling": op8_sentencepiece_sampling,
    "op9_secret_scan": op9_secret_scan,
    "op10_toxicity": op10_toxicity,
    "op11_ngram_jaccard": op11_ngram_jaccard,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": oracles.DECONTAMINATE,
    "op2_substring_dedup": oracles.SUBSTRINGS,
    "op3_warc_archives": oracles.ARCHIVES,
    "op4_simhash_groups": oracles.SIMHASH,
    "op7_quality_rules": oracles.QUALITY,
    "op11_ngram_jaccard": JACCARD_SQL,
    "op12_periodic_runs": oracles.RUNS,
    "op13_merkle_manifest": MERKLE_SQL,
}
