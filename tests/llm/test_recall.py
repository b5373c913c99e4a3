"""Recall of op3 on pairs planted at known cosines, for the tables of this machine and for larger ones."""

import numpy as np
import pytest

from octetlake.llm import embedding_dedup
from octetlake.llm.common import table

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def unit(spark):
    x = np.array([r.embedding for r in table(spark, BIG, "embeddings").collect()], dtype=float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def turned(x, cosine, rng):
    """A vector at this cosine to each of x, in any direction."""
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True)


@pytest.mark.parametrize("bits", [12, 21, 24, 30])
def test_tables_follow_the_recall(bits, unit):
    q = embedding_dedup.fit_itq(unit, bits)
    y = turned(unit, 0.9, np.random.default_rng(11))
    assert (q.keys(unit) == q.keys(y)).any(axis=1).mean() >= 0.9


@pytest.mark.parametrize("bits", [None, 21, 24])
def test_links_of_planted_pairs(bits, spark, unit):
    """The whole operator against brute force, at its own bits and at those of a million vectors and more."""
    rng = np.random.default_rng(12)
    cosines = np.tile([0.88, 0.89, 0.9 + 1e-9, 0.91, 0.93, 0.96, 0.99], len(unit) // 7 + 1)[: len(unit)]
    x = np.concatenate([unit, np.concatenate([turned(unit[i : i + 1], c, rng) for i, c in enumerate(cosines)])])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = dict(embedding_dedup.near_duplicates(v, bits=bits).select("vec_id", "n_links").collect())
    n = np.array([got[i] for i in range(len(x))])
    assert near.sum() >= 2 * 1400 and (n <= near.sum(axis=1)).all()
    print(f"bits {bits}: recall {n.sum() / near.sum():.4f}, at 0.90 alone {n[len(unit) :][cosines == 0.9 + 1e-9].mean():.4f}")
    assert n.sum() >= 0.9 * near.sum()
    assert n[len(unit) :][cosines == 0.9 + 1e-9].mean() >= 0.9
