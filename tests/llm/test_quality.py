import re
from collections import Counter

import numpy as np
from cases import empty_docs, messy_docs, messy_rows, prose, rows_of

from fieldflow.llm import quality


def plain(text):
    """The measures of a text, by loops."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), len(lines), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


ROWS = [
    (400, "a b c d e a b c d e f", None, None),
    (401, "a b c d e f\na b c d e f\n \na b c d e f", None, None),
    (402, "one two three four five " * 3, None, None),
    (403, "#*$%&|<> ä|ß " * 40, "de", "s1"),
    (404, "x x x x x x x x x x x x", "en", "s1"),
]


def test_measures_against_loops(spark):
    rows = messy_rows() + ROWS
    got = quality.quality_report(messy_docs(spark, rows=rows))
    names = "doc_id n_words n_lines word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    expected = []
    for doc_id, text, *_ in rows:
        m = plain(text)
        expected.append((doc_id, *m, m[0] < 10 or 100 * m[5] > 20 * m[0]))
    assert rows_of(got.select(*names)) == sorted(expected, key=str)
    assert all(not r.kept for r in got.collect() if r.base_failed)


def test_slices_do_not_change_measures(monkeypatch):
    import pyarrow as pa

    texts = [t for _, t, *_ in messy_rows() + ROWS]
    whole = quality.measure.func(pa.array(texts, pa.string())).to_pylist()
    monkeypatch.setattr(quality, "SLICE_BYTES", 100)
    assert quality.measure.func(pa.array(texts, pa.string())).to_pylist() == whole
    assert quality.measure.func(pa.array(["x", *texts], pa.string())[1:]).to_pylist() == whole


def noisy_rows(n=400):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(n):
        words = prose(rng, 80).split()
        kind = "plain" if i % 10 else "noisy"
        if kind == "noisy":
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en" if i % 2 else "de", f"s{i % 3}"))
    return rows


def test_fences_drop_what_lies_far_outside_and_keep_the_rest(spark):
    got = {r.doc_id: r.kept for r in quality.quality_report(messy_docs(spark, rows=noisy_rows())).collect()}
    assert all(got[i] == (i % 10 != 0) for i in got)


def test_fences_follow_the_source(spark):
    """Where marks are usual, they are no fault."""
    rows = [(i, " ".join(w + ("##" if i >= 200 else "") for w in prose(np_rng(i), 60).split()), "en", "code" if i >= 200 else "prose") for i in range(400)]
    rows.append((900, rows[-1][1], "en", "prose"))
    got = {r.doc_id: r.kept for r in quality.quality_report(messy_docs(spark, rows=rows)).collect()}
    assert all(got[i] for i in range(400)) and not got[900]


def np_rng(seed):
    import random

    return random.Random(seed)


def test_fences_against_exact_quantiles(spark):
    rows = noisy_rows(900)
    docs = messy_docs(spark, rows=rows)
    measured = quality.quality_report(docs)
    limits = {(r.lang, r.source): r for r in quality.fences(measured.select("*")).collect()}

    def exact(rows):
        lengths = np.array([(m[2] + 1) / (m[0] + 1) for m in (plain(t) for _, t, *_ in rows)])
        a, b = np.quantile(lengths, [0.25, 0.75])
        return len(rows), b + 3 * (b - a)

    _, whole = exact(rows)
    for (lang, source), r in limits.items():
        n, by_lang = exact([x for x in rows if x[2] == lang])
        by_lang = (n * by_lang + 50 * whole) / (n + 50)
        n, own = exact([x for x in rows if x[2:] == (lang, source)])
        assert abs(r.max_word_length - (n * own + 50 * by_lang) / (n + 50)) < 0.2


def test_sources_that_differ_in_spread_alone(spark):
    """The same text passes where lengths of words vary, and fails where they hardly do."""
    rng = np_rng(4)
    text = lambda n: " ".join("x" * n + f"{rng.randrange(10**6):06d}" for _ in range(40))
    rows = [(i, text(rng.choice([2, 4, 6]) if i % 2 else 4), "en", "wide" if i % 2 else "narrow") for i in range(2000)]
    rows += [(5000, text(9), "en", "wide"), (5001, text(9), "en", "narrow")]
    got = {r.doc_id: r.kept for r in quality.quality_report(messy_docs(spark, rows=rows)).collect()}
    assert got[5000] and not got[5001] and all(got[i] for i in range(2000))


def test_one_repeated_line_is_no_evidence(spark):
    rows = [(i, "\n".join(prose(np_rng(9 * i + k), 12) for k in range(6)), "en", "s") for i in range(300)]
    rows.append((900, rows[0][1] + "\n" + rows[0][1].split("\n")[0].split(" ")[0] + "\n" + rows[0][1].split("\n")[0].split(" ")[0], "en", "s"))
    got = {r.doc_id: r.kept for r in quality.quality_report(messy_docs(spark, rows=rows)).collect()}
    assert got[900]


def test_small_groups_use_their_language(spark):
    rows = noisy_rows() + [(1000, "calm words only " + prose(np_rng(1), 30), "en", "tiny"), (1001, "#*# " * 30 + prose(np_rng(2), 30), None, None)]
    got = {r.doc_id: r.kept for r in quality.quality_report(messy_docs(spark, rows=rows)).collect()}
    assert got[1000] and not got[1001]


def test_stage_keeps_rows_whole(spark):
    docs = messy_docs(spark)
    out = quality.keep_good(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in quality.quality_report(docs).collect() if r.kept]
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, kept))


def test_nothing_to_measure(spark):
    assert quality.quality_report(empty_docs(spark)).collect() == []
    assert quality.keep_good(empty_docs(spark)).collect() == []
    bad = messy_docs(spark, rows=[(1, None, None, None), (2, "few words", "en", "a")])
    assert [r.kept for r in quality.quality_report(bad).collect()] == [False, False]
