"""Recall and shares of the permutation index, few candidates, vectors of other lengths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from photolake.llm import ann


def _frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.astype(float).tolist()}), "vec_id long, embedding array<float>")


def _recall(x, got, k=20):
    full, found, asked = x.astype(np.float32).astype(float), 0, 0
    for q, own in got.groupby("query_id"):
        score = np.einsum("ij,j->i", full, full[q])
        score[q] = -np.inf
        found += (own.score >= np.sort(score)[-k]).sum()
        asked += k
    return found / asked


@pytest.mark.parametrize("size,components", [(8_000, 256), (500, 64), (2_000, 64)])
def test_recall_by_components_and_size(spark, size, components):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(size, components)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = _frame(spark, x)
    got = ann.nearest(v, v.filter(F.col("vec_id") % max(size // 50, 1) == 0), row_block=4096).toPandas()
    assert got.query_id.nunique() >= 50 and _recall(x, got) >= 0.9


def test_share_follows_the_vectors():
    """Groups need few rows reranked, unit vectors of many components many."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    flat = ann.fit(unit(rng.normal(size=(4096, 64))))
    wide = ann.fit(unit(rng.normal(size=(4096, 256))))
    groups = ann.fit(unit(rng.normal(size=(4096, 32)) + 6 * rng.normal(size=(100, 32))[rng.integers(0, 100, 4096)]))
    assert 0.02 < flat.share < wide.share <= 1 and groups.probes < 0.3 * len(groups.pivots)


@pytest.mark.parametrize("n", [1, 2, 7, 20])
def test_fewer_candidates_than_wanted(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 5)).astype(np.float32)
    v = _frame(spark, x)
    got = ann.nearest(v, v).toPandas()
    assert len(got) == n * (n - 1)
    for q, own in got.groupby("query_id"):
        score = np.einsum("ij,j->i", x.astype(float), x[q].astype(float))
        want = sorted((-score[i], i) for i in range(n) if i != q)
        assert own.sort_values("rank").vec_id.tolist() == [i for _, i in want]


def test_other_lengths_are_searched_among_themselves(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(30)] + [(200, [1.0]), (201, [2.0]), (300, [1.0] * 9)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(v, v, row_block=8).toPandas()
    own = {i: np.array(e) for i, e in rows}
    for q in own:
        want = sorted((-float(own[q] @ own[i]), i) for i in own if i != q and len(own[i]) == len(own[q]))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        if len(own[q]) != 6:
            assert mine.vec_id.tolist() == [i for _, i in want]
        else:
            assert len(mine) == 20 and set(mine.vec_id) <= set(range(60))
    assert not (got.query_id == 300).any()
