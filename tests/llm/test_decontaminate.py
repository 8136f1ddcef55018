import random
import re

import pyarrow as pa
import pytest
from cases import empty_docs, messy_docs, messy_rows, rows_of

from fieldflow.llm import decontaminate as dec

VOCAB = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in ("n", "r", "st", "m", "x", "ll")]


def sentence(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def changed(rng, words, n_edits):
    words = list(words)
    for _ in range(n_edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(VOCAB)
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, rng.choice(VOCAB))
    return words


def distance(item, near):
    """Least edits of item to any stretch of near, by the full table."""
    row = [0] * (len(near) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(near, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_edit_distance_against_the_full_table():
    rng = random.Random(1)
    for _ in range(200):
        item = sentence(rng, rng.randrange(4, 12))
        near = sentence(rng, rng.randrange(0, 15)) + changed(rng, item, rng.randrange(0, 4)) + sentence(rng, 3)
        exact = distance(item, near)
        assert dec.least_edits(item, near) == exact
        for most in range(4):
            assert dec.least_edits(item, near, most) == exact or most < dec.least_edits(item, near, most) <= exact
    assert dec.least_edits(["a", "b"], []) == 2


@pytest.fixture(scope="module")
def leaked():
    """Items of 8 to 200 words; documents that hold one, with 0 to 20 % of its words edited; clean ones."""
    rng = random.Random(6)
    items = [(i, " ".join(sentence(rng, rng.choice([8, 9, 15, 20, 35, 59, 130, 200])))) for i in range(40)]
    rows = list(messy_rows())
    truth = {}
    for d in range(1000, 1240):
        item, text = rng.choice(items)
        words = text.split()
        n_edits = rng.randrange(0, len(words) // 5 + 1)
        body = sentence(rng, rng.randrange(0, 120)) + changed(rng, words, n_edits) + sentence(rng, rng.randrange(0, 120))
        if rng.random() < 0.5:
            body = [w.upper() + rng.choice(["", ",", ".", "!\n"]) for w in body]
        rows.append((d, " ".join(body), "en", "hot"))
        if (made := distance(words, [re.sub("[^a-z]", "", w.lower()) for w in body])) <= 0.2 * len(words):
            truth[d] = (item, made)
    rows += [(d, " ".join(sentence(rng, 300)), "en", "s1") for d in range(3000, 3060)]
    return items, rows, truth


def test_recall_and_exactness(spark, leaked):
    items, rows, truth = leaked
    got = {r.doc_id: r for r in dec.leak_report(messy_docs(spark, rows=rows), bench(spark, items)).collect()}
    assert len([1 for d in truth if got[d].contaminated]) >= 0.97 * len(truth)
    light = [d for d, (i, n) in truth.items() if n <= 0.1 * len(items[i][1].split())]
    assert len(light) > 50 and all(got[d].contaminated for d in light)
    for d, r in got.items():
        if r.contaminated:
            item, least = truth[d]
            assert item in r.item_ids and r.least_edits == least
    assert {d for d, r in got.items() if r.contaminated} <= set(truth)


def test_blocks_of_keys_change_nothing(spark, leaked, monkeypatch):
    items, rows, _ = leaked
    docs, items = messy_docs(spark, rows=rows[::3]), bench(spark, items)
    whole = rows_of(dec.leak_report(docs, items))
    monkeypatch.setattr(dec, "BLOCK_KEYS", 20_000)
    assert rows_of(dec.leak_report(docs, items)) == whole


def test_stage_drops_leaks_alone(spark, leaked):
    items, rows, truth = leaked
    docs = messy_docs(spark, rows=rows + rows[-300:])
    out = dec.drop_leaks(docs, bench(spark, items))
    assert out.columns == docs.columns
    report = [r.doc_id for r in dec.leak_report(docs, bench(spark, items)).collect() if not r.contaminated]
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, report))


def test_odd_benchmarks(spark):
    text = "one two three four five six seven eight nine ten"
    items = bench(spark, [(1, text), (1, text), (2, text), (None, text + " eleven"), (3, None), (4, ""), (5, "few words"), (6, "...")])
    rows = [(1, text, None, None), (1, "something else", None, None), (None, "x " + text, None, None), (2, "few words", None, None), (3, None, None, None)]
    got = dec.leak_report(messy_docs(spark, rows=rows), items)
    assert rows_of(got.select("doc_id", "contaminated", "item_ids")) == sorted(
        [(1, True, [1, 2]), (1, False, []), (None, True, [1, 2]), (2, True, [5]), (3, False, [])], key=str
    )
    none = bench(spark, [])
    assert not any(r.contaminated for r in dec.leak_report(messy_docs(spark), none).collect())
    assert dec.leak_report(empty_docs(spark), items).collect() == []


def test_words_are_letters_and_digits():
    words, hashes, row = dec.word_hashes(pa.array(["A-b c1! Ünï", "", "x"]))
    assert words.to_pylist() == ["a", "b", "c1", "Ünï", "x"] and row.tolist() == [0, 0, 0, 0, 2]
    assert len(set(hashes.tolist())) == 5


def test_short_items_are_found_at_any_word(spark):
    rng = random.Random(9)
    lengths = (8, 9, 10, 11, 12, 14)
    items = [(i, " ".join(sentence(rng, lengths[i % 6]))) for i in range(60)]
    rows, exact, edited = [], [], []
    for d in range(1200):
        words = items[d % 60][1].split()
        light = d < 240
        made = words if light else changed(rng, words, len(words) // 5)
        body = sentence(rng, 30 + d // 60 % 2) + made + sentence(rng, 20)
        rows.append((d, " ".join(body), "en", "s"))
        if light or distance(words, body) <= len(words) // 5:
            (exact if light else edited).append(d)
    found = {r.doc_id for r in dec.leak_report(messy_docs(spark, rows=rows), bench(spark, items)).where("contaminated").collect()}
    assert set(exact) <= found
    recall = len(found & set(edited)) / len(edited)
    print("recall at the allowed edits", recall)
    assert recall >= 0.98


def test_items_without_words_are_told(spark):
    items = bench(spark, [(1, "one two three"), (2, None), (3, "a b c"), (4, "..., ")])
    assert {(r.item_id, r.n_words) for r in dec.unsearched(items).collect()} == {(2, 0), (4, 0)}


def spread(rng, words, n_edits):
    """Words replaced at equal distances."""
    words = list(words)
    for k in range(n_edits):
        words[(2 * k + 1) * len(words) // (2 * n_edits)] = rng.choice(VOCAB)
    return words


def test_recall_by_length(spark):
    """Every length, at even and odd words, edits drawn at random and evenly spaced."""
    rng = random.Random(12)
    lengths = [*range(3, 34), 40, 60, 100, 200]
    items, rows, by_length = [], [], {}
    for n in lengths:
        for k in range(6):
            item = len(items)
            items.append((item, " ".join(sentence(rng, n))))
            words = items[-1][1].split()
            for j in range(8):
                made = (changed if j % 2 else spread)(rng, words, n // 5)
                body = sentence(rng, 20 + j // 2 % 2) + made + sentence(rng, 20)
                if distance(words, body) <= n // 5:
                    by_length.setdefault(n, []).append((len(rows), item))
                rows.append((len(rows), " ".join(body), "en", "s"))
    found = dec.leak_report(messy_docs(spark, rows=rows, extra=False), bench(spark, items)).collect()
    held = {(r.doc_id, i) for r in found for i in r.item_ids}
    recall = {n: sum(p in held for p in pairs) / len(pairs) for n, pairs in by_length.items()}
    print(recall)
    assert all(r == 1 for n, r in recall.items() if n < dec.SHORT)
    assert all(r >= 0.95 for r in recall.values()) or min(recall.values()) >= 0.9 and sum(recall.values()) >= 0.97 * len(recall)


def test_short_items_word_for_word(spark):
    items = bench(spark, [(1, "the capital of france is paris"), (2, "yes indeed"), (3, "one two three four five")])
    texts = ["We know: The capital of France is Paris.", "the capital of spain is paris", "the capital of spain is madrid", "Yes, indeed!", "yes and indeed", "one two four five", "one three five"]
    got = dec.leak_report(messy_docs(spark, rows=[(i, t, None, None) for i, t in enumerate(texts)]), items)
    assert {r.doc_id: r.item_ids for r in got.collect() if r.contaminated} == {0: [1], 1: [1], 3: [2], 5: [3]}


def test_reports_equal_all_pairs(spark):
    """Documents against items by full tables: nothing is found that is not there, and short items wholly."""
    rng = random.Random(31)
    few = VOCAB[:14]
    items = [(i, " ".join(rng.choice(few) for _ in range(rng.randrange(1, 13)))) for i in range(25)]
    rows = [(d, " ".join(rng.choice(few) for _ in range(rng.randrange(0, 40))), None, None) for d in range(120)]
    got = {r.doc_id: r.item_ids for r in dec.leak_report(messy_docs(spark, rows=rows), bench(spark, items)).collect()}
    for d, text, _, _ in rows:
        want = [i for i, t in items if distance(t.split(), text.split()) <= len(t.split()) // 5]
        assert got[d] == want


def test_runs_that_edits_leave():
    assert {n: dec.run_length(n) for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15)} == {
        1: 1, 2: 2, 4: 4, 5: 2, 6: 3, 7: 3, 8: 4, 9: 4, 10: 3, 11: 3, 12: 4, 14: 4, 15: 3
    }
    assert all(dec.run_length(n) == 4 for n in range(16, 5000))
