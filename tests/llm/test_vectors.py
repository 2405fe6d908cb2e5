"""Operators on embeddings: hard negatives and whitening, against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.oracle_check import canonical, connect, same

from tapeloom.llm import negatives, queries, whitening

COLUMNS = "vec_id bigint, embedding array<float>, label int, row int, index string, q double"


def table(spark, rows):
    """(vec_id, embedding, label) rows beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "i", 0.5) for r in rows], COLUMNS)


def odd_rows(seed=5, n=300, d=7):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, d))
    rows = [(i, (centres[i % 4] + 0.4 * r.normal(size=d)).tolist(), int(r.integers(0, 3))) for i in range(n)]
    rows += [(n + i, rows[7][1], i % 2) for i in range(60)]  # a group of equal vectors
    rows += [(0, rows[0][1], 1), (50, rows[50][1], rows[50][2]), (50, rows[50][1], rows[50][2])]  # repeated ids and rows
    rows += [(900, None, 1), (901, [math.nan] * d, 1), (902, [math.inf] * d, 1), (903, [0.0] * (d - 1) + [None], 1), (904, [], 1)]
    rows += [(905, [0.5] * (d + 1), 1), (950, [0.1] * d, None), (None, [0.2] * d, 1), (1000, [0.0] * d, 2)]
    return rows


def brute_negatives(rows, d, anchor, positives=5, number=3):
    held = [(i, np.floor(256 * np.array(v, np.float32).astype(float)), t) for i, v, t in rows
            if i is not None and t is not None and v is not None and len(v) == d and None not in v and np.isfinite(v).all()]
    out = []
    for a, (i, q, t) in enumerate(held):
        if not anchor(i):
            continue
        scored = sorted((-int(q @ x), j, s == t, b) for b, (j, x, s) in enumerate(held) if b != a)
        for ps, p, *_ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:number]
            out += [(i, p, k + 1, s[1], -ps, -s[0]) for k, s in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"size": 3, "shard_rows": 17, "slice_anchors": 4}, {"size": 64, "shard_rows": 40, "slice_anchors": 1}])
def test_negatives_equal_brute_force(spark, sizes):
    rows = odd_rows()
    got = negatives.mine(table(spark, rows), anchor=F.col("vec_id") % 10 == 0, **sizes)
    want = brute_negatives(rows, 7, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def test_negatives_equal_sql(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        got = queries.op11_hard_negatives(spark, folder).toPandas()
        want = connect(folder).execute(queries.OP11_SQL).df()
        assert same(canonical(got), canonical(want))[0] and len(got) and list(got.dtypes) == list(want.dtypes)


def test_negatives_of_no_rows_no_anchors_and_one_label(spark):
    anchor = F.col("vec_id") % 10 == 0
    assert negatives.mine(table(spark, []), anchor=anchor).count() == 0
    assert negatives.mine(table(spark, [(1, None, 1), (2, [], 1)]), anchor=anchor).count() == 0
    assert negatives.mine(table(spark, [(1, [1.0], 1), (2, [0.5], 2)]), anchor=anchor).count() == 0
    assert negatives.mine(table(spark, [(10, [1.0], 1), (20, [0.5], 1)]), anchor=anchor).count() == 0
    got = negatives.mine(table(spark, [(10, [1.0], 1), (2, [1.0], 1), (3, [0.9], 2), (4, [1.0], 2), (5, [0.4], 2)]), anchor=anchor)
    assert [tuple(r) for r in got.collect()] == [(10, 2, 1, 3, 65536, 58880)]


def test_a_heap_visits_cells_by_falling_bound():
    r = np.random.default_rng(1)
    first, second = r.normal(size=9), r.normal(size=6)
    cells = [[10 * a + b for b in range(6)] for a in range(9)]
    want = sorted(((first[a] + second[b], 10 * a + b) for a in range(9) for b in range(6)), reverse=True)
    assert negatives._Heap(first, second).take(-np.inf, 99, cells) == [c for _, c in want]
    heap = negatives._Heap(first, second)
    stop = want[20][0]
    assert heap.take(stop, 7, cells) + heap.take(stop, 99, cells) == [c for s, c in want if s >= stop]


def test_bounds_hold_for_every_row(spark):
    rows = table(spark, [r for r in odd_rows() if r[1] and len(r[1]) == 7 and None not in r[1] and np.isfinite(r[1]).all() and r[2] is not None])
    plain = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label",
                        F.transform("embedding", lambda c: F.floor(256 * c).cast("int")).alias("q"))
    index, filed = negatives.build_index(plain, 7, size=5, shard_rows=30)
    held = filed.toPandas()
    q = np.stack(held.q).astype(float)
    assert (index.shard_bounds(q)[:, held.shard] >= q @ q.T).all()
    assert held.shard.nunique() == index.shards and held.groupby("shard").size().max() <= 60


def whitened(rows, d, components=32):
    x = np.array([np.floor(64 * np.array(v, np.float32).astype(float)) for _, v, _ in rows
                  if v is not None and len(v) == d and None not in v and np.isfinite(v).all()])
    n, s = len(x), x.sum(0)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True).reshape(d, d))
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 16, "matrix_blocks": 3}, {"block_rows": 50, "components": 3}])
def test_whitening_equals_brute_force(spark, sizes):
    rows = odd_rows()
    got = whitening.whiten(table(spark, rows).repartition(5), **sizes).toPandas()
    n, deviation, y, explained = whitened(rows, 7, sizes.get("components", 32))
    assert (got.n == n).all() and len(got) == n * len(explained) and (got.identity_error <= 1e-9).all() and got.identity_error.nunique() == 1
    for k, part in got.groupby("component"):
        assert np.allclose(part.explained, explained[k - 1], rtol=1e-9)
        mine, want = np.sort(part.whitened), np.sort(y[:, k - 1])
        assert np.allclose(mine, want, atol=1e-8) or np.allclose(mine, np.sort(-want), atol=1e-8)
        assert sorted(part.deviation) == sorted((deviation + 0.5).astype(np.int64))
    assert got[got.component == 1].vec_id.isna().sum() == 1  # the row without an id


def test_whitening_of_rows_without_variance(spark):
    for rows in ([], [(1, None, 0)], [(1, [], 0)], [(1, [0.5, 0.25], 0)], [(i, [0.5, 0.25], 0) for i in range(9)]):
        got = whitening.whiten(table(spark, rows))
        assert got.count() == 0 and got.columns[0] == "vec_id" and len(got.columns) == 7
    flat = whitening.whiten(table(spark, [(i, [i / 8, 0.5, -i / 8], 0) for i in range(9)])).toPandas()
    assert sorted(flat.component.unique()) == [1] and np.allclose(flat.explained, 1) and math.isclose((flat.whitened**2).mean(), 1)


def test_whitening_of_a_table(spark):
    got = queries.op12_embedding_whitening(spark, "/root/testdata/sf0.001").toPandas()
    held = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    n, _, y, explained = whitened(held[["vec_id", "embedding", "label"]].itertuples(index=False), 64)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[held.vec_id].to_numpy()
    assert wide.shape == (n, 32) and np.allclose(np.abs(wide), np.abs(y), atol=1e-6)
    assert np.allclose(got.groupby("component").explained.first(), explained)
