"""What callers keep of the latest pattern matches is asked of written rows, never of the score formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tapeloom.operators import patterns
from tapeloom.sources.tables import Market
from tests.oracle_check import canonical, connect, same

FOLDER = "/root/testdata/sf0.001"


def equals_sql(spark, name: str) -> tuple[bool, str]:
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = connect(FOLDER).execute(entry.oracle_sql()[name]).df()
    return same(canonical(got), canonical(want))


def test_filters_do_not_reach_the_score_formulas(spark):
    found = patterns.latest_matches(Market(spark, FOLDER).bars0).where(F.col("status") == "matched")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and len(plan) < 5_000


def test_pool_equals_sql(spark):
    ok, why = equals_sql(spark, "pat_pool")
    assert ok, why


def test_list_of_each_category_equals_sql(spark):
    df = entry.queries()["top_per_category"](spark, FOLDER)
    assert "volume" not in df._jdf.queryExecution().analyzed().toString()  # an input of the score formulas
    ok, why = equals_sql(spark, "top_per_category")
    assert ok, why
