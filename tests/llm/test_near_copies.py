"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

from test_llm import documents

import corpus_pipeline
from tracewright.llm.common import DOC_COLUMNS


def brute_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_stage_removes_near_copies_of_jaccard_80(spark):
    rng = random.Random(8)
    rows = []
    for size in [30, 60, 120, 400] * 8:
        words = [f"w{rng.randrange(3000)}" for _ in range(size)]
        rows.append(" ".join(words))
        for edits in (0, 1, 1, 2, 4):
            copy = list(words)
            for _ in range(edits * size // 100 + (edits > 0)):
                copy[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy).upper())
    rows = list(enumerate([*rows, None, "", "one two", "One  two", "one three"]))
    sets, root = [brute_shingles(t) for _, t in rows], list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert sum(rows[i][1] != rows[j][1] for i, j in pairs) > 100
    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    kept = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), None)
    assert kept.columns == DOC_COLUMNS
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(rows))})
    assert corpus_pipeline.drop_near_copies(spark, documents(spark, []), None).count() == 0
