import numpy as np
import pytest

from emberlog.llm import blocks as B


@pytest.mark.parametrize("n", [1, 2, 255, 5000, 300_000])
def test_packed_keys_come_back(n):
    rng = np.random.default_rng(n)
    edges = np.array([0, (1 << 64) - 1], dtype=np.uint64)
    for keys in (rng.integers(0, 1 << 64, n, dtype=np.uint64), np.arange(n, dtype=np.uint64), edges):
        keys = np.unique(keys)
        assert (B.unpack_keys(B.pack_keys(keys), len(keys)) == keys).all()
    many = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    assert len(B.pack_keys(many)) <= 7 * len(many)


def test_counts_in_the_narrowest_type():
    for top in (0, 255, 256, 70_000, 1 << 40):
        counts = np.array([0, 1, top])
        assert (B.widened(B.smallest(counts), 3) == counts).all()
