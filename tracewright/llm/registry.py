"""Queries of the llm operators, and SQL for those that SQL can express."""

from . import decontaminate, delta_lloyd, html_extract, line_dedup, near_dup, packing, pii, quality_classifier, quality_rules, sharding, source_divergence, url_filter, warc

QUERIES = {
    "op1_packing": packing.query,
    "op2_decontaminate": decontaminate.query,
    "op3_quality_rules": quality_rules.query,
    "op4_html_extract": html_extract.query,
    "op5_url_filter": url_filter.query,
    "op6_quality_classifier": quality_classifier.query,
    "op7_warc": warc.query,
    "op8_surrogates": pii.query,
    "op9_sharding": sharding.query,
    "op10_near_dup": near_dup.query,
    "op11_source_divergence": source_divergence.query,
    "op12_delta_lloyd": delta_lloyd.query,
    "op13_line_dedup": line_dedup.query,
}
SQL = {
    "op2_decontaminate": decontaminate.SQL,
    "op3_quality_rules": quality_rules.SQL,
    "op5_url_filter": url_filter.SQL,
    "op7_warc": warc.SQL,
    "op10_near_dup": near_dup.SQL,
    "op11_source_divergence": source_divergence.SQL,
    "op12_delta_lloyd": delta_lloyd.SQL,
    "op13_line_dedup": line_dedup.SQL,
}
