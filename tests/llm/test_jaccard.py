import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import empty_docs, messy_docs, messy_rows, rows_of

from fieldflow.llm import jaccard

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, shingle=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset()


def plain_components(rows, percent=80):
    """All pairs of rows by their sets."""
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=str)


def words(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(400)}" for _ in range(n)]


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10**6)}"
    return out


def crowd(seed=3, copies=70):
    """Near copies of several bases at every similarity, copies of copies, and a passage that many hold."""
    rng = random.Random(seed)
    rows, n = [], 1000
    passage = words(rng, 40)
    for size in (12, 60, 150):
        base = words(rng, size)
        for k in range(copies):
            text = edited(rng, base, rng.randrange(0, max(2, size // 12)))
            if k % 7 == 0:
                base = edited(rng, base, 2)  # the family drifts
            if k % 11 == 0:
                text += words(rng, size // 8)
            rows.append((n, " ".join(text).upper() if k % 5 == 0 else " ".join(text), "en", "hot"))
            n += 1
    for k in range(60):
        rows.append((n, " ".join(words(rng, rng.randrange(5, 120)) + passage), "en", "s1"))
        n += 1
    for k in range(60):  # short sets, where one shingle more or less decides
        rows.append((n, " ".join(passage[: 5 + k % 9] + words(rng, k % 2)), "en", "s2"))
        n += 1
    rows.append((n, rows[0][1], "en", "s1"))
    return rows


@pytest.mark.parametrize("paired,later,rounds", [(3, 16, 6), (0, 0, 3), (0, 0, 1), (1000, 16, 6)])
def test_equals_all_pairs(spark, monkeypatch, paired, later, rounds):
    """Whatever becomes a pivot, and wherever rounds end, components are those of all pairs."""
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "PAIRED_LATER", later)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    rows = crowd() + (messy_rows() if paired == 3 else [])
    got = jaccard.near_duplicates(messy_docs(spark, rows=rows))
    assert rows_of(got) == plain_components(rows)


def test_parts_of_any_rate(spark, monkeypatch):
    rows = crowd(seed=8, copies=25)
    for rates in ((0.0,), (0.05, 0.3, 0.0)):  # 0.05 leaves no set enough parts, so the next one is taken
        monkeypatch.setattr(jaccard, "PART_RATES", rates)
        assert rows_of(jaccard.near_duplicates(messy_docs(spark, rows=rows, extra=False))) == plain_components(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", None, None), (3, "a b", None, None), (4, "A  B\n", None, None), (None, "a b", None, None), (5, "b a", None, None), (None, None, None, None)]
    got = jaccard.near_duplicates(messy_docs(spark, rows=rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (None, 1, 3), (5, 1, 5), (None, 0, None)]
    assert rows_of(got) == sorted(want, key=str)
    assert jaccard.near_duplicates(empty_docs(spark)).collect() == []


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(100):
        a = rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64)
        b = np.concatenate([a[rng.integers(0, len(a)) :], rng.integers(0, 2**63, rng.integers(0, 300), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if len(b):
            apart = len(np.setxor1d(a, b))
            assert jaccard.hamming(jaccard.narrow_sketch(a), jaccard.narrow_sketch(b)) <= apart
            band = np.array([jaccard.band_of(np.array([max(len(a), len(b))]))[0]])
            for rate in (0.3, 0.6, 0.0):
                keys = [set(jaccard.parts_in_band(np.zeros(len(s), int), s, band, np.full(64, rate))[1].tolist()) for s in (a, b)]
                assert len(keys[0] - keys[1]) <= apart and len(keys[1] - keys[0]) <= apart
    assert len(jaccard.shingle_sets(pa.array(["a b c d e f a b c d e", "x", " "]))[1]) == 6 + 1
