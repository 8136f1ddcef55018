import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from cases import empty_docs, messy_docs, messy_rows, rows_of
from pyspark.sql import functions as F

from fieldflow.llm import langid


@pytest.fixture(scope="module")
def pieces():
    return langid.read_pieces(langid.VOCABULARY)


def toy(extra=(b"ab", b"bc", b" a", b"abc", b" ab")):
    return langid.Pieces(list(extra))


def all_cuts(word, longest):
    if not word:
        yield []
    for k in range(1, min(len(word), longest) + 1):
        for rest in all_cuts(word[k:], longest):
            yield [word[:k], *rest]


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    own = toy()
    names = sorted({bytes([b]) for b in range(256)} | {b"ab", b"bc", b" a", b"abc", b" ab"})
    p = rng.uniform(0.01, 1, (own.size + 1, 3))
    p[-1] = 0
    for word in (b" ", b" a", b" abc", b" abcab", b"zzabcabc"):
        at = own.at(np.frombuffer(word, np.uint8)[None])
        got = langid.forward(at, p, len(word))[0, -1]
        expected, uses = np.zeros(3), np.zeros(own.size + 1)
        for cut in all_cuts(word, 16):
            if all(c in names for c in cut):
                odds = np.prod([p[names.index(c)] for c in cut], axis=0)
                expected += odds
                for c in cut:
                    uses[names.index(c)] += odds[0]
        assert got == pytest.approx(expected)
        counts = langid.expected_counts(at, p[:, :1], len(word), np.array([2.0]))
        assert counts[:-1] == pytest.approx(2 * uses[:-1] / expected[0])


def recursed(word, p, number):
    """The sum over all segmentations, in exact fractions, by what a segmentation may end with."""
    sums = [Fraction(1)]
    for j in range(1, len(word) + 1):
        sums.append(sum(sums[j - k] * p[number[word[j - k : j]]] for k in range(1, j + 1) if word[j - k : j] in number))
    return sums[-1]


def test_long_words_sum_all_segmentations():
    """Words of 33 to 100 bytes and pieces of up to 40, against exact fractions; counts against the sum's slope."""
    rng = np.random.default_rng(7)
    extra = [b"ab", b" a", b"abc", b"ba" * 9, b"c" * 20, b"a" * 40]
    for taken in (extra[:-1], extra):
        own = langid.Pieces([*taken, b"no piece of any word", b"--------" * 9])
        assert own.longest == max(map(len, taken))
        names = sorted({bytes([b]) for b in range(256)} | {*taken, b"no piece of any word", b"--------" * 9})
        number = {x: i for i, x in enumerate(names)}
        p = 10.0 ** rng.uniform(-8, 0, (own.size + 1, 2))
        p[-1] = 0
        exact = [[Fraction(x) for x in p[:, k]] for k in range(2)]
        for n in (33, 34, 64, 65, 77, 100):
            words = [bytes(rng.choice(list(b"abc"), n - 1).tolist()) for _ in range(3)] + [b"a" * (n - 1), (b"ba" * n)[: n - 1]]
            words = [b" " + w for w in words]
            matrix = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n)
            got = langid.log_forward(own, p, matrix)
            for word, row in zip(words, got):
                whole = [recursed(word, exact[k], number) for k in range(2)]
                assert row == pytest.approx([math.log(x.numerator) - math.log(x.denominator) for x in whole])
            behind = langid.log_backward(own, p[:, 0], matrix)
            assert behind[:, 0] == pytest.approx(got[:, 0])
        counts = langid.long_counts(own, p[:, 0], matrix[:1], np.array([2.0]))
        whole = recursed(words[0], exact[0], number)
        for piece in {*taken, b"a", b"b", b" "}:
            i, step = number[piece], Fraction(1, 10**40)
            more = [x + step * (j == i) for j, x in enumerate(exact[0])]
            slope = (recursed(words[0], more, number) - whole) / step
            assert counts[i] == pytest.approx(float(2 * exact[0][i] * slope / whole), abs=1e-9)


def test_short_and_long_sweeps_agree(pieces):
    rng = np.random.default_rng(2)
    p = rng.uniform(1e-6, 1e-4, (pieces.size + 1, 3))
    p[-1] = 0
    matrix = np.frombuffer(" überraschungen der sprach".encode() * 2, np.uint8).reshape(2, -1)[:, : langid.BLOCK]
    at = pieces.at(matrix)
    assert langid.log_forward(pieces, p, matrix) == pytest.approx(np.log(langid.forward(at, p, matrix.shape[1])[:, -1]))
    weight = np.array([1.0, 3.0])
    expected = langid.expected_counts(at, p[:, :1], matrix.shape[1], weight)
    assert langid.long_counts(pieces, p[:, 0], matrix, weight)[:-1] == pytest.approx(expected[:-1])


def test_words_of_all_lengths(pieces):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.choice([1, 3, 9, 40, 200]))) for _ in range(60)] + ["", "a"]
    p = np.full((pieces.size + 1, 2), 1 / pieces.size)
    p[-1] = 0
    p[:, 1] *= 0.5
    together = langid.word_scores(pieces, p, words)
    assert np.isfinite(together).all()
    for word, row in zip(words, together):
        assert langid.word_scores(pieces, p, [word])[0] == pytest.approx(row)
    assert np.isfinite(langid.word_scores(pieces, p, ["é" * 20_000])).all()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    syllables = {"aa": "ka to mi ra ne so".split(), "bb": "sch ung er ver kt ich".split(), "cc": "ção nh lh õe que".split()}
    text = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(n)).title()
    return [(i, text(lang, 20 + i % 30), lang, "s") for i in range(300) for lang in ["aa", "bb", "cc"][i % 3 : i % 3 + 1]]


def test_held_out_accuracy_on_invented_languages(spark, corpus):
    rows = corpus + [(1000, corpus[0][1], None, None)]
    got = langid.language_report(messy_docs(spark, rows=rows)).collect()
    truth = {r[0]: r[2] for r in corpus} | {1000: "aa"}
    held = [r for r in got if r.held_out]
    assert len(held) > 40 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_accuracy_on_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 150 and right >= 0.97 * n


def test_odd_rows(spark):
    rows = [*messy_rows(), (600, "123 .,; \n", "en", "s"), (601, "中文 字", "en", "s")]
    docs = messy_docs(spark, rows=rows)
    got = langid.language_report(docs)
    by_id = {r.doc_id: r for r in got.collect()}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (100, 101, 102, 106, 600))
    assert by_id[601].lang_pred in ("en", "de") and by_id[103].lang_pred in ("en", "de")
    assert rows_of(got) == rows_of(langid.language_report(docs.repartition(3)).withColumn("score", F.col("score")))
    assert langid.language_report(empty_docs(spark)).collect() == []
    unlabelled = messy_docs(spark, rows=[(1, "some text", None, None), (2, None, "en", None)])
    assert {r.lang_pred for r in langid.language_report(unlabelled).collect()} == {"und"}


def test_extra_columns_and_the_row_bound(spark, corpus, pieces):
    docs = messy_docs(spark, rows=corpus)
    languages, p = langid.learn(docs.select("doc_id", "lang", "text"), pieces, max_rows=30)
    assert languages == ["aa", "bb", "cc"] and p.shape == (pieces.size + 1, 3)
    out = langid.identify(docs, languages, p, pieces)
    assert out.columns == [*docs.columns, "lang_pred_", "lang_score"]
    assert out.where("lang = lang_pred_").count() > 0.98 * len(corpus)


def test_slices_do_not_change_scores(pieces, monkeypatch):
    from fieldflow.llm import quality

    texts = pa.array([t or "" for _, t, *_ in messy_rows()[-12:]])
    p = np.random.default_rng(1).uniform(1e-6, 1e-4, (pieces.size + 1, 2))
    p[-1] = 0
    whole = langid._predict(pieces, p, texts)
    for i in range(len(texts)):
        assert langid._predict(pieces, p, texts.slice(i, 1))[0] == pytest.approx(whole[i])
    monkeypatch.setattr(quality, "SLICE_BYTES", 10)
    assert len(list(quality.slices(texts))) > 5
