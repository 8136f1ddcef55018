"""Spelling variants: words of a corpus that are one edit apart, and the form each one probably stands for.

A word's letter counts are a vector. One inserted or deleted letter moves it by a squared distance of 1, one
replaced letter by 2, so near words are at most two apart and their lengths differ by at most one. NumPy products of
count matrices (Gram matrices) give all squared distances of a block of words to another; pairs at most
two apart are then checked letter by letter.

Only blocks that can hold near words meet. A block's signature is its words' counts over ``n_groups`` groups of
letters, balanced by how often they are used. A replacement lowers one of these by one and raises one by one, or changes
none; an insertion raises one; so each signature meets itself and a few neighbours, of its own or the next
length. The number of groups grows with the vocabulary, and a signature that still has more than ``BLOCK``
words is dealt into several blocks which all meet: no word is left out, and a task holds two blocks at a time.

A word's form is its near word with the largest count, the smallest in code-point order of several, if that is at least ``RATIO``
times its own. Counts at least double from a word to its form, so a chain has at most log2 of the largest
count steps; it is followed by doubling.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one where a run is
damaged; repeated rows count again; a word without near words is its own root; no documents give no words;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import combinations
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldflow.llm import frames
from fieldflow.llm.quality import slices, words_of
from fieldflow.session import cut_lineage

MIN_LETTERS, MIN_COUNT = 5, 3
RATIO = 2
DAMAGE = 97  # a run whose digest this divides loses a letter
BLOCK = 512
#: a-z and U+00C0 to U+00FF, in code-point order
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]

_RUN_BYTES = np.full(256, 32, dtype=np.uint8)  # ASCII letters, lower-cased; everything else is white
for _b in range(97, 123):
    _RUN_BYTES[_b] = _RUN_BYTES[_b - 32] = _b


def letter_text(text: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and everything but the letters a-z and U+00C0 to U+00FF white.

    In UTF-8 these last are the byte C3 and one more, and C3 begins nothing else.
    """
    text = pa.concat_arrays([text])
    size = np.frombuffer(text.buffers()[1], np.int32)[len(text)] if len(text) else 0
    if not size:
        return text
    raw = np.frombuffer(text.buffers()[2], np.uint8)[:size]
    data = _RUN_BYTES[raw]
    lead = np.flatnonzero(raw == 0xC3)
    data[lead] = 0xC3
    data[lead + 1] = raw[lead + 1]
    return pa.StringArray.from_buffers(len(text), text.buffers()[1], pa.py_buffer(data.tobytes()))


def _counts(batches):
    """(word, n) of each slice of (doc_id, text), with a run damaged where its digest says so."""
    for batch in batches:
        text = pc.fill_null(batch.column(1).cast(pa.string()), "")
        for a, b in slices(text):
            words, row = words_of(letter_text(text.slice(a, b - a)))
            long = pc.greater_equal(pc.utf8_length(words), MIN_LETTERS)  # losing a letter makes none long enough
            words, row = words.filter(long).dictionary_encode(), row[long.to_numpy(zero_copy_only=False)]
            if not len(words):
                continue
            coded, n_words = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
            total = np.bincount(coded, minlength=n_words)
            pairs, times = np.unique(row * n_words + coded, return_counts=True)
            doc, code = np.divmod(pairs, n_words)
            runs = words.dictionary.cast(pa.binary()).to_pylist()
            ids = ["" if i is None else str(i) for i in batch.column(0).slice(a, b - a).to_pylist()]
            begun = [zlib.crc32(f"{i}:".encode()) for i in ids]
            crc = zlib.crc32
            digest = np.fromiter(
                (crc(runs[c], begun[d]) for d, c in zip(doc.tolist(), code.tolist())), np.int64, len(pairs)
            )
            hurt = np.flatnonzero(digest % DAMAGE == 0)
            made: dict[str, int] = {}
            for i in hurt.tolist():
                run = runs[code[i]].decode()
                at = int(digest[i]) % len(run)
                made[run[:at] + run[at + 1 :]] = made.get(run[:at] + run[at + 1 :], 0) + int(times[i])
            np.subtract.at(total, code[hurt], times[hurt])
            here = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([words.dictionary.take(pa.array(here)), pa.array(list(made), pa.string())]),
                    pa.array(np.concatenate([total[here], np.array(list(made.values()), dtype=np.int64)])),
                ],
                ["word", "n"],
            )


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least ``MIN_LETTERS`` letters and ``MIN_COUNT`` occurrences in all texts."""
    picked = frames.pick(docs, doc_id="long", text="string")
    counted = picked.mapInArrow(_counts, "word string, n long").where(F.length("word") >= MIN_LETTERS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of counts over ``LETTERS`` per word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    column = np.where(codes < 0x80, codes - 0x61, codes - 0xC0 + 26)
    flat = np.bincount(row * len(LETTERS) + column, minlength=len(words) * len(LETTERS))
    return flat.reshape(len(words), len(LETTERS))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter leads from one to the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def near_pairs(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of words of two blocks that are one edit apart."""
    x, y = letter_counts(left).astype(np.float32), letter_counts(right).astype(np.float32)
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return [(i, j) for i, j in np.argwhere(squared <= 2.5).tolist() if one_edit(left[i], right[j])]


def _met(batches):
    """Rows (same block, words, words) to pairs of near words, each pair once."""
    for batch in batches:
        for k in range(batch.num_rows):  # one pair of blocks in memory at a time
            same, left, right = (batch.column(i)[k].as_py() for i in range(3))
            found = near_pairs(left, right)
            if same:
                found = [(i, j) for i, j in found if i < j]
            if found:
                pairs = [pa.array([left[i] for i, _ in found]), pa.array([right[j] for _, j in found])]
                yield pa.RecordBatch.from_arrays(pairs, ["a", "b"])


def letter_groups(used: dict[str, int], n_groups: int) -> list[str]:
    """Letters in groups of about equal use: the next most used joins the least used group."""
    groups, load = [""] * n_groups, [0] * n_groups
    for letter in sorted(map(chr, LETTERS), key=lambda c: (-used.get(c, 0), c)):
        at = load.index(min(load))
        groups[at] += letter
        load[at] += used.get(letter, 0) + 1
    return groups


def _steps(n_groups: int) -> list[list[int]]:
    """From a signature to those that near words may have, each pair of signatures in one direction only."""
    unit = np.eye(n_groups, dtype=int)
    replaced = [unit[j] - unit[i] for i, j in combinations(range(n_groups), 2)]
    return [s.tolist() for s in [0 * unit[0], *unit, *replaced]]


def near_words(words: DataFrame, block: int = BLOCK, n_groups: int | None = None) -> DataFrame:
    """(a, b): every pair of words in ``words`` (word) that are one edit apart, once.

    By default there are 4 groups of letters up to 300,000 words and two more for each power of ten above.
    """
    n_groups = n_groups or max(4, 2 * round(log10(max(1, words.count()))) - 6)
    letters = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count()
    used = {r["c"]: r["count"] for r in letters.collect()}  # at most one row per letter
    groups = letter_groups(used, n_groups)
    count = lambda g: (F.length("word") - F.length(F.translate("word", g, ""))).cast("int")
    signed = words.select("word", F.array(*[count(g) for g in groups]).alias("sign"))
    sizes = signed.groupBy("sign").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("word"), F.ceil(F.col("n") / block)).alias("part")
    blocks = signed.join(sizes, "sign").select("sign", part, "word").groupBy("sign", "part")
    blocks = cut_lineage(blocks.agg(F.sort_array(F.collect_list("word")).alias("words")), "spelling-blocks")
    steps = F.array(*[F.array(*map(F.lit, s)) for s in _steps(n_groups)])
    reach = blocks.select("sign", "part", "words", F.explode(steps).alias("step")).select(
        F.zip_with("sign", "step", lambda a, b: a + b).alias("to"),
        F.aggregate("step", F.lit(0), lambda n, s: n + F.abs(s)).alias("moved"),
        F.col("part").alias("l_part"),
        F.col("words").alias("l_words"),
    )
    met = reach.join(blocks, F.col("to") == F.col("sign")).where((F.col("moved") > 0) | (F.col("l_part") <= F.col("part")))
    same = (F.col("moved") == 0) & (F.col("l_part") == F.col("part"))
    return met.select(same.alias("same"), "l_words", "words").mapInArrow(_met, "a string, b string")


def _roots(words: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, for words that have one."""
    links = cut_lineage(words.where("form is not null").select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(onward, "root", "left")
        if not moved.where("next is not null").limit(1).count():
            return links
        links = cut_lineage(moved.select("word", F.coalesce("next", "root").alias("root")), "spelling-forms")


def variants(words: DataFrame, ratio: float = RATIO, **options) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word in ``words`` (word, n)."""
    words = cut_lineage(words.select("word", "n"), "spelling-words")
    pairs = cut_lineage(near_words(words.select("word"), **options), "spelling-near")
    both = pairs.union(pairs.select("b", "a"))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    # min of (-n, word): the largest count, then the smallest word
    best = counted.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near"))).alias("best")
    )
    chosen: Column = -F.col("best.less") >= ratio * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word",
        F.when(chosen, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(chosen, -F.col("best.less")).alias("form_n"),
    )
    formed = cut_lineage(formed, "spelling-formed")
    named = formed.join(_roots(formed), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_report(docs: DataFrame) -> DataFrame:
    return variants(vocabulary(docs))
