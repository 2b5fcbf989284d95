"""Registered queries of this package: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tripledger.llm import centroids, decontamination, exact_dedup, substring_dedup, suffix_dedup
from tripledger.llm.centroids import op13_centroids
from tripledger.llm.decontamination import op11_decontamination
from tripledger.llm.exact_dedup import op7_exact_dedup
from tripledger.llm.packing import op4_packing
from tripledger.llm.quality import op6_quality
from tripledger.llm.sentencepiece_ids import op8_sentencepiece
from tripledger.llm.simhash import op2_simhash
from tripledger.llm.spotsigs import op3_spotsigs
from tripledger.llm.substring_dedup import op1_substring_dedup
from tripledger.llm.suffix_dedup import op10_suffix_dedup
from tripledger.llm.token_files import op5_token_files
from tripledger.llm.toxicity import op9_toxicity
from tripledger.llm.whitening import op12_whitening

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash": op2_simhash,
    "op3_spotsigs": op3_spotsigs,
    "op4_packing": op4_packing,
    "op5_token_files": op5_token_files,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_decontamination": op11_decontamination,
    "op12_whitening": op12_whitening,
    "op13_centroids": op13_centroids,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op10_suffix_dedup": suffix_dedup.ORACLE,
    "op11_decontamination": decontamination.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
