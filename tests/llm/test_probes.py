"""Links met by the lists that op2 visits, on data that spreads along few directions with noise in all others."""

import numpy as np
import pytest

from palisade.llm import embeddings


def spread(n, rank, noise, d=64):
    rng = np.random.default_rng(rank)
    axes = np.linalg.qr(rng.normal(size=(d, rank)))[0]
    x = rng.normal(size=(n, rank))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes.T + noise * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def met(x, index, rows=1500):
    """The share of linked pairs of the first rows of which one end visits the other's list."""
    home, _, _, probes = index.coded(x)
    visits = np.zeros((len(x), index.norms.size), bool)
    visits[np.arange(len(x)), home] = True
    for i, p in enumerate(probes):
        visits[i, p] = True
    hit = total = 0
    for at in range(0, rows, 500):
        i, j = np.nonzero(x[at : at + 500] @ x.T >= 0.9)
        i += at
        i, j = i[i != j], j[i != j]
        hit, total = hit + (visits[i, home[j]] | visits[j, home[i]]).sum(), total + len(i)
    return hit / total


@pytest.mark.parametrize(("rank", "noise"), [(2, 0.03), (3, 0.02), (3, 0.03), (4, 0.01), (6, 0.02)])
def test_probes_meet_links_of_noisy_low_rank(rank, noise):
    x = spread(12_000, rank, noise)
    for coarse in (4096, 8):  # one level of lists, and two
        index = embeddings.ProductIndex.fitted(x, len(x), 0.9, coarse)
        assert index.norms.size >= 40 and met(x, index) >= 0.99
    part = embeddings.ProductIndex.fitted(x[:2000], 50_000, 0.9)  # a sample that stands for more
    assert part.norms.size == 195 and met(x, part) >= 0.99


def test_counts_of_noisy_low_rank(spark):
    x = spread(3000, 2, 0.03)
    want = (x @ x.T >= 0.9).sum(1) - 1
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(rows).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
