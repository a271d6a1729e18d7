"""Candidates of the near-duplicate stage meet in balls: exactly the pairs of which a word differs in at most two bits."""

import numpy as np

from tracewright.llm import near_copies


def test_words_within_two_bits_meet(spark):
    rng = np.random.default_rng(5)
    one = rng.integers(0, 2, (60, near_copies.SKETCH_BITS), dtype=np.uint8)
    bits = np.concatenate([one, *(one ^ (rng.random(one.shape) < p) for p in (0, 0.05, 0.15, 0.2, 0.3))]).astype(np.uint8)
    rows = [(i, bytes(np.packbits(b, bitorder="little"))) for i, b in enumerate(bits)]
    nodes = spark.createDataFrame(rows, "node long, sketch binary")
    for n in (len(rows), 300_000):
        words = near_copies.plan_words(n)
        near = np.array([(bits[:, None, w] != bits[None, :, w]).sum(axis=2) <= 2 for w in words]).any(axis=0)
        met = np.zeros_like(near)
        for r in near_copies._buckets(nodes, n).collect():
            assert len(set(r.nodes)) == len(r.nodes) > 1
            a = np.array(r.nodes)
            # Members of a ball are within a bit of its center, so within two of each other.
            met[np.ix_(a, a)] = True
        np.fill_diagonal(near, False)
        np.fill_diagonal(met, False)
        assert near.sum() > 600 and (near == met).all()
