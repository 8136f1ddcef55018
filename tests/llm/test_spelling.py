import random
import re
import zlib
from collections import Counter

import numpy as np
from cases import LONG, empty_docs, messy_docs, messy_rows, rows_of

from fieldflow.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 3}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_report(n):
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and edit_distance(v, w) == 1] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n), key=str)


def rows_with_variants(seed=2):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aeiouslntrÄéß×÷") for _ in range(rng.randrange(5, 12))) for _ in range(25)]
    rows = []
    for d in range(400):
        said = []
        for _ in range(30):
            w = stems[min(rng.randrange(25), rng.randrange(25))]
            at, kind = rng.randrange(len(w)), rng.randrange(12)
            letter = rng.choice("aeé")
            said.append(w[:at] + [w[at:], w[at + 1 :], letter + w[at:], letter + w[at + 1 :]][kind if kind < 4 else 0])
        rows.append((d, rng.choice([" ", "-", "Ā", "1", "中"]).join(said), "de", "hot"))
    return rows


def test_report_equals_plain_version(spark):
    rows = rows_with_variants() + messy_rows() + rows_with_variants()[:50]
    n = plain_words(rows)
    assert len(n) > 150
    got = spelling.spelling_report(messy_docs(spark, rows=rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == plain_report(n)


def test_small_blocks_and_any_groups_change_nothing(spark):
    n = plain_words(rows_with_variants(7))
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = plain_report(n)
    for block, groups in ((5, 4), (1, 2), (1000, 1), (512, 9)):
        assert rows_of(spelling.variants(words, block=block, n_groups=groups)) == want


def test_counts_and_products():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abÿ") for _ in range(rng.randrange(4, 8))) for _ in range(150)})
    counts = spelling.letter_counts(words)
    assert counts.sum(1).tolist() == [len(w) for w in words] and counts[:, -1].tolist() == [w.count("ÿ") for w in words]
    found = set(spelling.near_pairs(words, words))
    assert found == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if edit_distance(a, b) == 1}
    steps = np.array(spelling._steps(5))
    assert len(steps) == 1 + 5 + 10 and set(steps.sum(1).tolist()) == {0, 1}


def test_ties_chains_and_odd_rows(spark):
    rows = [("hause", 3), ("hausen", 6), ("hauses", 6), ("hausenx", 12), ("solo", 4), ("single", 9), ("hausx", 3)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert (got["hause"].form, got["hause"].root, got["hause"].form_n) == ("hausen", "hausenx", 6)
    assert got["hause"].n_near == 3 and got["hausx"].form is None and got["hausx"].n_near == 1
    assert (got["single"].form, got["single"].root, got["single"].n_near, got["single"].form_n) == (None, "single", 0, None)
    assert spelling.spelling_report(empty_docs(spark)).collect() == []
    odd = [(1, None, None, None), (2, "", None, None), (None, LONG, None, None), (3, "y" * 60_000 + " " + "y" * 60_000, None, None), (4, "y" * 60_000, None, None)]
    assert rows_of(spelling.spelling_report(messy_docs(spark, rows=odd))) == plain_report(plain_words(odd))
