"""The cube method holds both totals of a block: tokens and documents."""

import numpy as np
import pytest

from tidemark.llm import mixing


@pytest.mark.parametrize("n", [1, 2, 13, 40, 300, 1000])
@pytest.mark.parametrize("share", [0.1, 0.5, 0.83])
def test_tokens_and_documents_of_a_block(n, share):
    rng = np.random.default_rng(n)
    x = np.floor(rng.lognormal(5, 1.2, n)) + 1
    p = np.full(n, share)
    q = mixing.sample(p, x, np.random.default_rng(7))
    assert set(np.unique(q)) <= {0.0, 1.0}
    assert abs(q.sum() - p.sum()) <= (1.0 if n >= 300 else 2.0)
    assert abs(q @ x - p @ x) <= (0.5 * x.mean() if n >= 300 else 2 * x.max())
    assert (q == mixing.sample(p, x, np.random.default_rng(7))).all()


def test_equal_sizes_and_empty_documents():
    for x in (np.full(200, 50.0), np.zeros(200), np.r_[np.zeros(100), np.full(100, 9.0)]):
        q = mixing.sample(np.full(200, 0.37), x, np.random.default_rng(1))
        assert abs(q.sum() - 74) <= 1 and abs(q @ x - 0.37 * x.sum()) <= max(1.0, x.max())
    sure = mixing.sample(np.array([0.0, 1.0, 1.0]), np.array([3.0, 4.0, 5.0]), np.random.default_rng(1))
    assert sure.tolist() == [0.0, 1.0, 1.0]


def test_documents_of_each_source_come_near_their_share(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.lognormal(3, 1)), f"s{rng.choice(3, p=[0.7, 0.2, 0.1])}") for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in got.groupby("source"):
        ratio = g["target"].iloc[0] / g["source_size"].iloc[0]
        blocks = -(-len(g) // 1000)
        assert abs(g["copies"].sum() - ratio * len(g)) <= 3 * blocks and abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].mean() * blocks
