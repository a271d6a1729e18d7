"""The induced suffix sort against plain sorting, in memory and through files; operator 8 over its rare paths."""

import random

import numpy as np
import pytest
from test_llm import brute_repeats, documents

from tracewright.llm import repeats, suffix_sort


@pytest.mark.parametrize("held, buckets", [(1 << 22, 2048), (5, 2048), (1 << 22, 0), (5, 0)])
def test_suffixes_and_common_prefixes(tmp_path, monkeypatch, held, buckets):
    monkeypatch.setattr(suffix_sort, "MOST_HELD", held)
    monkeypatch.setattr(suffix_sort, "MOST_BUCKETS", buckets)
    rng = random.Random(held + buckets)
    for trial in range(60):
        alphabet = rng.choice([b"ab", b"abc", b"a", b"abcdefgh \n"])
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        texts += [texts[0] + b"zz", texts[0]] if trial % 3 == 0 else []
        order, shared, left = suffix_sort.sort_texts(texts, 20, str(tmp_path / "q"))
        ends = set((np.cumsum([len(t) + 1 for t in texts]) - 1).tolist())
        raw = b"\0".join([*texts, b"\0"])
        s = [1 if i in ends else c + 2 for i, c in enumerate(raw)]
        s[-1] = 0
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert order.tolist() == want
        for i in range(1, len(s)):
            k = 0
            while s[want[i - 1] + k] == s[want[i] + k] > 1 and k < 20:
                k += 1
            assert min(shared[i], left[want[i]], left[want[i - 1]]) == k


def compare(spark, texts):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(documents(spark, list(enumerate(texts)))).collect())
    assert got == [(i, *b) for i, b in enumerate(brute_repeats(texts))]


def common_line(n, seed=9):
    """Texts that share short and long parts in other surroundings, so that anchors have many different fragments."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefé ") for _ in range(k))
    shared, line = word(1200), word(60)
    return [word(rng.randint(0, 500)) + line + word(rng.randint(0, 500)) + shared[rng.randint(0, 500) : rng.randint(700, 1200)] + word(300) for _ in range(n)]


def test_anchor_with_many_fragments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "FRAGMENTS_A_SHARD", 2)
    compare(spark, [*common_line(25), "ab" * 700, "ab" * 900, "x" + "ab" * 500])


def test_text_beyond_a_piece(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    texts = common_line(8, 4)
    compare(spark, [*texts, "".join(texts), "a" * 2500])
