"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from nearfield.llm import decontaminate, language, line_dedup, media, ngram_join, pseudonyms, quality, token_files, url_rules, word_bpe

OPERATORS = {
    "op1_media_columns": (media.op1, media.ORACLE_SQL),
    "op2_line_dedup": (line_dedup.op2, line_dedup.ORACLE_SQL),
    "op3_pii_pseudonyms": (pseudonyms.op3, pseudonyms.ORACLE_SQL),
    "op4_language_id": (language.op4, language.ORACLE_SQL),
    "op5_word_bpe": (word_bpe.op5, word_bpe.ORACLE_SQL),
    "op6_url_filters": (url_rules.op6, url_rules.ORACLE_SQL),
    "op7_quality_cotraining": (quality.op7, quality.ORACLE_SQL),
    "op8_token_files": (token_files.op8, token_files.ORACLE_SQL),
    "op9_ngram_jaccard": (ngram_join.op9, ngram_join.ORACLE_SQL),
    "op10_decontamination": (decontaminate.op10, decontaminate.ORACLE_SQL),
}


def queries():
    import corpus_pipeline

    return {k: f for k, (f, _) in OPERATORS.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    import corpus_pipeline

    found = {k: sql for k, (_, sql) in OPERATORS.items()} | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: sql for k, sql in found.items() if sql}
