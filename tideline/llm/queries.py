"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import jaccard, language, media, mixing, packing, quality, scoring, secrets, suffixes, token_files

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_language_id": language.op2_language_id,
    "op3_token_files": token_files.op3_token_files,
    "op4_jpeg_media": media.op4_jpeg_media,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_suffix_dedup": suffixes.op6_suffix_dedup,
    "op7_ngram_jaccard_join": jaccard.op7_ngram_jaccard_join,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_masked_lm_scoring": scoring.op10_masked_lm_scoring,
}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.oracle_sql(),
    "op5_source_mixing": mixing.oracle_sql(),
}
