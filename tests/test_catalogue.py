"""Queries against their SQL oracles in DuckDB, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from quillgrid import catalogue

QUICK = ["percentage_entities", "date_entities", "money_entities", "iban_entities", "bin_entities", "address_entities", "words_scan", "box_measures", "iban_checksum", "written_values", "normalised_text", "payload_errors", "word_table", "region_of_word", "line_assembly", "line_context", "words_right", "lines_below", "nearest_words", "find_words", "text_spans", "page_columns", "bank_value_scan", "page_quality", "engine_issues", "dedup_exact", "overlap_components", "resolution_issues", "blocks_asof", "compact_identifiers", "recognised_digits", "normal_texts", "recognised_ibans", "other_ibans", "recognised_bank_codes", "bank_values", "linked_bank_values", "broken_rules", "production_json", "public_job_view", "found_documents", "filtered_entities", "engine_summaries", "label_places", "looked_up_words", "region_lines", "same_line_words", "reordered_pages", "value_indexes", "document_counts", "document_lookups", "checked_uploads", "too_many_files", "job_status", "job_expiry"]
NAMES = list(catalogue.QUERIES) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_oracle(spark, data, name):
    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    got, expected = catalogue.QUERIES[name](spark, data).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    order = lambda d: d[sorted(d.columns)].astype(str).sort_values(sorted(d.columns)).reset_index(drop=True)
    assert order(got).equals(order(expected))


def test_all_queries_have_oracles():
    assert set(catalogue.ORACLES) == set(catalogue.QUERIES)
