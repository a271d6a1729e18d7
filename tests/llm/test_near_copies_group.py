"""Comparisons of the near-duplicate stage inside one large group of texts that are alike but mostly not near copies."""

import random

from test_llm import documents
from test_near_copies import brute_shingles

from tracewright.llm import near_copies


def test_large_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(3)
    base, rows = [f"w{rng.randrange(9000)}" for _ in range(150)], []
    for i in range(0, 400, 2):
        # Two texts have seven changes of six places in common, so that neither has a shingle of its own there.
        places = rng.sample(range(0, 150, 10), 6)
        for _ in range(2):
            copy = list(base)
            for p in places:
                copy[p] = f"x{i}y{p}"
            copy[rng.choice([3, 4, 5, 6, 7])] = "z"
            rows.append(" ".join(copy))
    rows = list(enumerate([" ".join(base), *rows]))
    sets, root = [brute_shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    compared, near = [], near_copies._near

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return near(pairs, *rest)

    monkeypatch.setattr(near_copies, "_near", counting)
    kept = near_copies.keep_one(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and len(set(root)) > 150
    assert sum(compared) < 20 * len(rows)
