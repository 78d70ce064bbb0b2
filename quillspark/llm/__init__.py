"""Operators of a training-data pipeline. Nothing outside this package imports it."""


def queries() -> dict:
    """The query of each operator: (spark, sf_dir) -> DataFrame."""
    from . import decontaminate, jaccard_join, language_id, line_dedup, mixing, quality, secrets, suffix_dedup, url_filter, warc

    found = (
        warc.op1_legacy_archive_converter, mixing.op2_weighted_fair_mix, secrets.op3_secret_scan, quality.op4_quality_rules, line_dedup.op5_line_dedup,
        url_filter.op6_url_filter, jaccard_join.op7_ngram_jaccard_join, language_id.op8_language_id, decontaminate.op9_benchmark_decontamination, suffix_dedup.op10_suffix_array_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    from . import mixing, oracles, url_filter, warc

    return {
        "op1_legacy_archive_converter": warc.OP1_SQL, "op2_weighted_fair_mix": mixing.OP2_SQL, "op4_quality_rules": oracles.OP4,
        "op6_url_filter": url_filter.OP6_SQL, "op7_ngram_jaccard_join": oracles.OP7, "op9_benchmark_decontamination": oracles.OP9,
    }
