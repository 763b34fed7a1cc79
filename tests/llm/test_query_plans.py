"""Plans of the corpus queries: pushed filters, pruned columns, no product of rows."""

from __future__ import annotations

import pytest

from notaflux.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_note_filter_and_columns_reach_the_scan(spark):
    p = plan(Q.p1_found(spark, SMALL))
    assert "EqualTo(note_name,evolucao_uti)" in p and "ReadSchema: struct<note_id:bigint,note_name:string,text:string,lang:string,received_at" in p


def test_each_text_is_scanned_once(spark):
    p = Q.p1_found(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("ArrowEvalPython") == p.count("Relation [")


@pytest.mark.parametrize("name", ["p6_found", "p7_found", "p8_ids", "p10_found"])
def test_no_product(spark, name):
    assert "CartesianProduct" not in plan(Q.queries()[name](spark, SMALL))


def test_splitting_is_shuffle_free(spark):
    assert "Exchange" not in plan(Q.p10_found(spark, SMALL))


def test_term_counts_sort_in_ranges(spark):
    assert "rangepartitioning" in plan(Q.p7_counts(spark, SMALL))


def test_term_counts_scan_sorted_rows(spark):
    p = plan(Q.p7_counts(spark, SMALL))
    assert p.index("MapInArrow") < p.index("Sort [g") < p.index("rangepartitioning")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_every_query_runs(spark, name):
    assert Q.queries()[name](spark, SMALL).count() > 0 or name in ("p6_found", "p2_found")
