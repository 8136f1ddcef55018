import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cases import WORDS, empty_docs, messy_docs, messy_rows, prose, rows_of

from fieldflow.llm import components, quality, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def plain_report(rows):
    """(doc_id, fingerprint, component_id), all pairs compared."""
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    distinct = sorted(set(fps))
    found = plain_components([p for p in combinations(distinct, 2) if (p[0] ^ p[1]).bit_count() <= 2], distinct)
    least = {}
    for (doc_id, *_), fp in zip(rows, fps):
        if doc_id is not None:
            least[found[fp]] = min(least.get(found[fp], doc_id), doc_id)
    return sorted(((r[0], f"{fp:016x}", least.get(found[fp])) for r, fp in zip(rows, fps)), key=str)


def copied_rows(seed=4, n=120):
    """Messy rows, exact copies under other identifiers, and near copies of long texts."""
    rng = random.Random(seed)
    rows = list(messy_rows())
    base = [prose(rng, 400) for _ in range(6)]
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((2000 - i, " ".join(words), "en", "hot"))
    return rows


def test_report_against_all_pairs(spark):
    rows = copied_rows()
    assert rows_of(simhash.near_duplicates(messy_docs(spark, rows=rows))) == plain_report(rows)


def test_fingerprints_do_not_depend_on_slices(monkeypatch):
    texts = [t for _, t, *_ in copied_rows()]
    expected = [plain_fingerprint(t) - (plain_fingerprint(t) >> 63 << 64) for t in texts]
    print_ = simhash.fingerprint().func
    assert print_(pa.array(texts, pa.string())).to_pylist() == expected
    monkeypatch.setattr(quality, "SLICE_BYTES", 50)
    assert print_(pa.array(texts, pa.string())).to_pylist() == expected


def clustered(rng, n_groups, size, spread=3):
    """Crowded groups in Hamming space, and some lone values."""
    out = {0, 2**64 - 1}
    for _ in range(n_groups):
        centre = rng.getrandbits(64)
        for _ in range(size):
            value = centre
            for _ in range(rng.randrange(spread + 1)):
                value ^= 1 << rng.randrange(64)
            out.add(value)
    return sorted(out | {rng.getrandbits(64) for _ in range(200)})


@pytest.mark.parametrize("n_groups, size, bucket", [(3, 200, 16), (40, 6, 16), (3, 120, 2), (5, 60, 1000)])
def test_links_reach_what_all_pairs_reach(spark, n_groups, size, bucket):
    values = clustered(random.Random(size), n_groups, size)
    signed = [v - (v >> 63 << 64) for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = [(r.a, r.b) for r in simhash.near_links(fps, pair_bucket=bucket).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    all_pairs = [p for p in combinations(signed, 2) if ((p[0] ^ p[1]) & (2**64 - 1)).bit_count() <= 2]
    got, expected = plain_components(links, signed), plain_components(all_pairs, signed)
    assert partition(got) == partition(expected)


def partition(roots):
    groups = {}
    for node, root in roots.items():
        groups.setdefault(root, []).append(node)
    return sorted(sorted(g) for g in groups.values())


def test_every_threshold_vector_finds_every_close_pair(spark, monkeypatch):
    """The pigeonhole holds for each number of partitions, also those the costs would not choose."""
    rng = random.Random(9)
    pairs = []
    for _ in range(150):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 3)))))
    values = sorted({v - (v >> 63 << 64) for p in pairs for v in p})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for partitions in ((2,), (3,), (4,)):
        masks = simhash.probe_masks(fps, partitions=partitions)
        for a, b in pairs:
            assert any(((a ^ b) & m) == 0 for m in masks)
    monkeypatch.setattr(simhash, "PROBE_COST", 0.0)
    masks = simhash.probe_masks(fps)
    assert all(any(((a ^ b) & m) == 0 for m in masks) for a, b in pairs)


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(1)
    from itertools import product

    for _ in range(30):
        m = int(rng.integers(2, 5))
        cost = [sorted(rng.uniform(0, 100, 4).tolist()) for _ in range(m)]
        total = 2 - m + 1
        best = min(sum(c[t + 1] for c, t in zip(cost, ts)) for ts in product(range(-1, 3), repeat=m) if sum(ts) == total)
        found, chosen = simhash.allocate(cost, total)
        assert found == pytest.approx(best) and sum(chosen) == total


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (500, 64)).astype(float)
    bits[:, 40] = bits[:, 7]
    bits[:, 55] = 1 - bits[:, 7]
    groups = simhash.group_bits(bits.T @ bits, 500, 4)
    assert sorted(sum(groups, [])) == list(range(64)) and {len(g) for g in groups} == {16}
    assert any({7, 40, 55} <= set(g) for g in groups)


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(0)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(200)]
    links = chain + star + star + [(5000, 5000), (7, 7)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == nodes and partition(got) == partition(plain_components(chain + star, nodes))


def test_one_row_of_each_component_stays(spark):
    rows = copied_rows()
    docs = messy_docs(spark, rows=rows)
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    report = plain_report(rows)
    # doc_id 1 has two texts, so two components have 1 as their smallest identifier
    assert len(kept) == len({c for *_, c in report}) + 1
    assert {r.doc_id for r in kept} == {c for *_, c in report}
    assert all(r.doc_id == r["a.b"] for r in kept)


def test_nothing_and_one(spark):
    assert simhash.near_duplicates(empty_docs(spark)).collect() == []
    assert simhash.keep_one(empty_docs(spark)).collect() == []
    one = messy_docs(spark, rows=[(None, None, None, None)] * 3)
    assert [tuple(r) for r in simhash.near_duplicates(one).collect()] == [(None, "0" * 16, None)] * 3
    assert simhash.keep_one(one).count() == 1
