"""Plans as they are meant: filters and columns reach the scan, nothing runs in Python or is shuffled without need."""

from __future__ import annotations

import pytest

from notaflux.plans import registry

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["entities", "relations", "summary_json", "tokens", "sentences", "normalize_nfc", "fhir_sections", "clinical_flow"])
def test_no_python_worker(spark, name):
    assert "Python" not in plan(registry.queries()[name](spark, SMALL)) and "InPandas" not in plan(registry.queries()[name](spark, SMALL))


@pytest.mark.parametrize(("name", "columns"), [("entities", "o_orderkey:bigint,o_custkey"), ("normalize_lower", "doc_id:bigint,text:string>"), ("clinical_flow", "note_id:bigint,note_name:string,text:string,received_at")])
def test_only_the_columns_needed_are_read(spark, name, columns):
    assert f"ReadSchema: struct<{columns}" in plan(registry.queries()[name](spark, SMALL))


def test_document_changes_move_nothing(spark):
    for name in ("normalize_symbols", "normalize_whitespace", "normalize_nfc", "remove_accents", "document_sentences"):
        assert "Exchange" not in plan(registry.queries()[name](spark, SMALL))
