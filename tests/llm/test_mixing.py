import random
import re
from collections import defaultdict

import pytest
from cases import empty_docs, messy_docs, messy_rows, prose, rows_of

from pyspark.sql import functions as F

from fieldflow.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Reshare what stands above the limits until nothing does."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, left = {}, float(sum(sizes.values()))
    while open_ := [s for s in order if s not in fixed]:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in open_}
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]
    return fixed


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_sizes_on_messy_rows(spark):
    rows = messy_rows()
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += size(text)
    targets = plain_targets(sizes)
    got = mixing.mix_report(messy_docs(spark)).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, _, _ in rows)
    by_size = {v: k for k, v in sizes.items()}
    for r in got:
        assert r.target == pytest.approx(targets[by_size[r.source_size]])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]


@pytest.mark.parametrize("seed", range(6))
def test_targets_by_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {rng.choice("abcdefgh") + str(i): int(10 ** rng.uniform(0, 6)) for i in range(rng.randrange(1, 12))} | {None: 17}
    df = spark.createDataFrame([(mixing_key(s), n) for s, n in sizes.items()], "key string, size long")
    got = {r.key: r.target for r in mixing.source_targets(df).collect()}
    expected = {mixing_key(s): t for s, t in plain_targets(sizes).items()}
    assert got == pytest.approx(expected)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def mixing_key(source):
    return "b" if source is None else "a" + source


def test_taken_words_come_near_their_target(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, int(10 ** rng.uniform(0.7, 2.3))), "en", ["big", "mid", "small"][min(2, int(rng.expovariate(1.2)))]) for i in range(3000)]
    for cell_rows in (50, 4096):  # cells of any number give the same documents
        got = mixing.mix_report(messy_docs(spark, False, rows), cell_rows=cell_rows).collect()
        taken, target = defaultdict(int), {}
        for r in got:
            taken[r.source_size] += r.taken
            target[r.source_size] = r.target
        assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)
        if cell_rows == 50:
            first = sorted((r.doc_id, r.copies) for r in got)
    assert first == sorted((r.doc_id, r.copies) for r in got)


def test_copies_cross_whole_numbers(spark):
    """Against one prefix sum over the ordered documents of a source."""
    rows = [(i, prose(random.Random(i), 5 + i % 40), "en", "ab"[i % 7 == 0]) for i in range(400)]
    got = mixing.mix_report(messy_docs(spark, False, rows), cell_rows=16).collect()
    for total in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == total]
        rate = own[0].target / total
        counts = [r.copies for r in own]
        assert {min(counts), max(counts)} <= {int(rate), int(rate) + 1}
        assert abs(sum(counts) - rate * len(own)) <= 1.001


def test_rows_without_an_identifier_are_dealt_by_text(spark):
    """A third of the rows without an identifier, another under one: no crowded cell, and no dependence on row order."""
    rng = random.Random(8)
    rows = [([None, 5, i][i % 3], prose(rng, 12), "en", "a" if i % 10 else "b") for i in range(3000)]
    docs = messy_docs(spark, False, rows)
    cells = mixing._parts(
        mixing._placed(mixing._narrow(docs), 42), mixing._cells(mixing._placed(mixing._narrow(docs), 42), (5, 2, 1), 3, 42, 50)[0]
    ).where("doc_id is null").groupBy("key", "size_class", "part").count()
    assert cells.selectExpr("max(count)").first()[0] <= 100
    first = rows_of(mixing.mix(docs, cell_rows=50))
    assert first == rows_of(mixing.mix(docs.orderBy(F.rand(1)).repartition(5), cell_rows=50))


def test_mix_repeats_whole_rows_and_agrees_with_report(spark):
    docs = messy_docs(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    report = sum(r.copies for r in mixing.mix_report(docs).collect())
    assert out.count() == report
    assert rows_of(out) == rows_of(mixing.mix(docs.repartition(5)))


def test_nothing_gives_nothing(spark):
    assert mixing.mix_report(empty_docs(spark)).collect() == []
    assert mixing.mix(empty_docs(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, None, "a"), (2, "", None, None)], "doc_id long, text string, lang string, source string")
    assert [(r.target, r.taken) for r in mixing.mix_report(blank).collect()] == [(0, 0)] * 2
