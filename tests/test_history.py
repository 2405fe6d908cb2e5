"""Run history: published whole or not at all, filters as keys, statuses of every security."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import history as H
from tapeloom.operators.history import Filters

CATEGORIES = ("a", "b")
ROWS = "entity long, status string, matches array<struct<category:string,score:double>>, bar_date date, history_bars int, warning string"
DAY = dt.date(2024, 3, 1)


def evaluations(spark, scores: dict):
    rows = []
    for entity, found in scores.items():
        status = "not_calculated" if found is None else "matched" if found else "no_match"
        rows.append((entity, status, [(c, s) for c, s in (found or {}).items()], DAY, 10 if found is None else 120, "short" if found is None else None))
    return spark.createDataFrame(rows, ROWS)


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def add(spark, root, run, seq, day, scores, chosen=Filters(), saved=True):
    return H.append_run(spark, root, run, seq, F.lit(day), chosen, evaluations(spark, scores), CATEGORIES, saved)


FIRST = {1: {"a": 50.0, "b": 70.0}, 2: {"a": 60.0}, 3: {}, 4: None, 5: {"a": 60.0, "b": 60.0}}


def test_round_trip_with_every_status(spark, root):
    assert add(spark, root, "r1", 0, DAY, FIRST)
    run = H.manifests(spark, root).first()
    assert (run.evaluated, run.result_count, run.filters) == (5, 3, Filters().canonical())
    assert [(c.category, c.n) for c in run.counts] == [("a", 3), ("b", 2)] and run.warnings == ["1 securities without enough history"]
    status = {r.entity: r.status for r in H.published(spark, root, "evaluations").collect()}
    assert status == {1: "matched", 2: "matched", 3: "no_match", 4: "not_calculated", 5: "matched"}
    got = [(r.rank, r.entity, r.category, r.score, r.category_rank) for r in H.published(spark, root, "results").orderBy("rank").collect()]
    assert got == [(1, 1, "b", 70.0, 1), (2, 2, "a", 60.0, 1), (3, 5, "a", 60.0, 2)]


def test_appending_again_changes_nothing(spark, root):
    assert add(spark, root, "r1", 0, DAY, FIRST)
    assert not add(spark, root, "r1", 1, DAY, {9: {"a": 1.0}})
    assert H.manifests(spark, root).count() == 1 and H.published(spark, root, "evaluations").count() == 5


def test_a_crash_between_writes_leaves_no_half_run(spark, root):
    H.create(spark, root)
    H.write_rows(spark, root, "r1", "lost", evaluations(spark, {7: {"a": 1.0}}), 100)  # and then no manifest
    assert H.published(spark, root, "evaluations").isEmpty() and H.published(spark, root, "results").isEmpty()
    assert add(spark, root, "r1", 0, DAY, FIRST)
    assert sorted(r.entity for r in H.published(spark, root, "evaluations").collect()) == [1, 2, 3, 4, 5]


def test_two_writers_of_one_run_show_one_attempt(spark, root):
    assert add(spark, root, "r1", 0, DAY, FIRST)
    row = H.manifests(spark, root)
    H.write_rows(spark, root, "r1", "0", evaluations(spark, {7: {"a": 1.0}}), 100)
    row.withColumn("attempt", F.lit("0")).select(*row.columns).write.mode("append").parquet(f"{root}/runs")
    assert [r.entity for r in H.published(spark, root, "evaluations").collect()] == [7]


def test_filter_keys():
    assert Filters(boards=("star", "main")).key == Filters(boards=("main", "star", "main")).key == Filters(min_cap=50.0).key
    others = [Filters(boards=("main",)), Filters(min_cap=None), Filters(min_cap=51), Filters(exclude_flagged=False), Filters(top_k=10)]
    assert len({Filters().key, *[f.key for f in others]}) == 6


def test_previous_counts_of_comparable_runs(spark, root):
    wide = Filters(boards=("growth",))
    add(spark, root, "old", 0, dt.date(2024, 1, 5), {1: {"a": 1.0}})
    add(spark, root, "other", 1, dt.date(2024, 2, 2), {1: {"a": 1.0}, 2: {"b": 1.0}}, wide)
    add(spark, root, "unsaved", 2, dt.date(2024, 2, 9), {}, saved=False)
    add(spark, root, "same day", 3, DAY, {3: {"b": 1.0}})
    add(spark, root, "new", 4, DAY, {1: {"a": 2.0}, 2: {"a": 1.0, "b": 1.0}})
    got = {(r.run, r.category): (r.n, r.previous_run, r.previous, r.change) for r in H.category_changes(H.manifests(spark, root)).collect()}
    assert got["new", "a"] == (2, "old", 1, 1) and got["new", "b"] == (1, "old", 0, 1)
    assert got["same day", "b"] == (1, "old", 0, 1) and got["unsaved", "a"] == (0, "old", 1, -1)
    assert got["old", "a"] == (1, None, None, None) and got["other", "b"] == (1, None, None, None)


def test_history_of_a_security(spark, root):
    add(spark, root, "one", 0, dt.date(2024, 1, 5), {1: {"a": 1.0}, 2: None})
    add(spark, root, "two", 1, dt.date(2024, 2, 2), {1: {}, 2: {"b": 3.0}}, saved=False)
    add(spark, root, "three", 2, DAY, {1: {}})
    rows = H.security_history(H.published(spark, root, "evaluations"))
    got = {(r.entity, r.nth): (r.run, r.status, r.state) for r in rows.collect()}
    assert got == {
        (1, 1): ("three", "no_match", "calculated_no_match"), (1, 2): ("one", "matched", "calculated_no_match"),
        (2, 1): ("one", "not_calculated", "not_calculated"),
    }
    assert H.security_history(H.published(spark, root, "evaluations"), keep=1).count() == 2
