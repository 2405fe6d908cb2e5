"""A sample of registered queries against their SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle_check import canonical, connect, same

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "top_template_latest", "prj_normalize_bars", "sim_rolling", "set_flow_group", "agg_distribution",
    "pat_score_stock", "hlth_snapshot", "dyn_transition", "met_ndcg", "dq_top100_identities",
    "prj_adjust_page", "his_previous_counts", "brd_detail", "thr_view", "sim_registry_top", "dq_registry",
]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["template_id", "rank", "entity", "score", "start_date", "end_date", "industry"]
    assert df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = connect(FOLDER).execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    ok, why = same(canonical(got), canonical(want))
    assert ok, why


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
